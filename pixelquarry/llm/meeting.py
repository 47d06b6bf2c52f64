"""Which fingerprints of a document other documents have too, asked by a shuffle on the fingerprint.

A piece of a partition sends each of its distinct fingerprints once, for the least of its documents that has it;
what its documents share with each other is settled on the spot. So a fingerprint that a third of
all documents hold reaches its reducer once for each piece and not once for each document. Fingerprints travel
packed by bucket, several documents to a row; replies come back as one row for each document and bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import mix64, pieces

#: Ids, 64-bit keys and, if the keys are to be longer, 32-bit further keys of what a piece asks about.
Asked = tuple[np.ndarray, np.ndarray, np.ndarray | None]
SCHEMA = "bucket int, settled boolean, ids binary, counts binary, keys binary, more binary"
#: Bytes of text whose fingerprints meet in one bucket.
BUCKET_TEXT = 32 << 20


def buckets_for(docs: DataFrame) -> int:
    """As many buckets as the texts' bytes call for, so that one fits in a task whatever the input's size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_TEXT))


def _distinct(ids: np.ndarray, keys: np.ndarray, more: np.ndarray | None, key_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """The entries by fingerprint and id without repeats, and where each fingerprint begins."""
    if more is None and key_bytes <= 6 and len(ids):
        edge = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        named, rank = np.unique(ids[edge], return_inverse=True)
        if len(named) <= 1 << 16:  # a key and the rank of its id are one number then
            both = np.sort(keys << np.uint64(16) | np.repeat(rank, np.diff(np.append(edge, len(ids)))).astype(np.uint64))
            both = both[np.concatenate(([True], both[1:] != both[:-1]))]
            keys, ids = both >> np.uint64(16), named[(both & np.uint64(0xFFFF)).astype(np.int64)]
            return ids, keys, None, np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    order = np.lexsort((ids, keys) if more is None else (ids, more, keys))
    ids, keys, more = ids[order], keys[order], None if more is None else more[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    if more is not None:
        new[1:] |= more[1:] != more[:-1]
    own = new.copy()
    own[1:] |= ids[1:] != ids[:-1]
    return ids[own], keys[own], None if more is None else more[own], np.flatnonzero(new[own])


def _found(ids: np.ndarray, first: np.ndarray, smaller: bool) -> np.ndarray:
    """Entries whose fingerprint, which begin at ``first``, a smaller id has, or else any other id."""
    if not len(ids):
        return np.zeros(0, dtype=bool)
    size = np.diff(np.append(first, len(ids)))
    least, most = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    return ids > np.repeat(least, size) if smaller else np.repeat(least < most, size)


def _rows(bucket: np.ndarray, ids: np.ndarray, keys: np.ndarray, more: np.ndarray | None, settled: bool, width: int) -> list[tuple]:
    if not len(bucket):
        return []
    order = np.lexsort((ids, bucket))
    bucket, ids, keys, more = bucket[order], ids[order], keys[order], None if more is None else more[order]
    rows = []
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        run = np.flatnonzero(np.concatenate(([True], ids[a + 1 : b] != ids[a : b - 1])))
        counts = np.diff(np.append(run, b - a)).astype(np.int32)
        size = 8 if settled else width
        packed = keys[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
        rows.append((int(bucket[a]), settled, ids[a:b][run].tobytes(), counts.tobytes(), packed, b"" if more is None or settled else more[a:b].tobytes()))
    return rows


def _unpack(rows: list[tuple], width: int, wide: bool) -> Asked:
    ids, keys, more = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for own, counts, packed, extra in rows:
        ids.append(np.repeat(np.frombuffer(own, np.int64), np.frombuffer(counts, np.int32)))
        key = np.zeros((len(ids[-1]), 8), dtype=np.uint8)
        key[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
        keys.append(key.view("<u8").ravel())
        more.append(np.frombuffer(extra, np.uint32))
    return np.concatenate(ids), np.concatenate(keys), np.concatenate(more) if wide else None


def ask(docs: DataFrame, asked: Callable[[pa.RecordBatch], Asked], buckets: int, smaller: bool, key_bytes: int = 8, wide: bool = False, piece_bytes: int = 4_000_000) -> DataFrame:
    """``doc_id`` and ``found``: arrays of packed 64-bit keys that another document has, or that a smaller ``doc_id`` has.

    ``asked`` gives the fingerprints of a batch's documents, document by document; keys must fit in ``key_bytes``.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=piece_bytes):
                ids, keys, more, first = _distinct(*asked(piece), key_bytes)
                known = _found(ids, first, smaller)
                spread = (mix64(ids[known].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                rows = _rows(spread, ids[known], keys[known], None, True, 8)
                ids, keys, more = ids[first], keys[first], None if more is None else more[first]  # the least id of each
                rows += _rows((mix64(keys) % np.uint64(buckets)).astype(np.int32), ids, keys, more, False, key_bytes)
                if rows:
                    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "settled", "ids", "counts", "keys", "more"])

    def reply(table: pa.Table) -> pa.Table:
        rows = list(zip(*[table.column(c).to_pylist() for c in ("settled", "ids", "counts", "keys", "more")], strict=True))
        ids, keys, more = _unpack([r[1:] for r in rows if not r[0]], key_bytes, wide)
        order = np.argsort(keys) if more is None else np.lexsort((more, keys))
        ids, keys, more = ids[order], keys[order], None if more is None else more[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        if more is not None:
            new[1:] |= more[1:] != more[:-1]
        known = _found(ids, np.flatnonzero(new), smaller)
        told, told_keys, _ = _unpack([r[1:] for r in rows if r[0]], 8, False)
        ids, keys = np.concatenate((ids[known], told)), np.concatenate((keys[known], told_keys))
        order = np.argsort(ids, kind="stable")
        ids, keys = ids[order], keys[order]
        cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(cut, len(ids))[1:] if len(ids) else cut
        packed = [keys[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
        return pa.table({"doc_id": pa.array(ids[cut], pa.int64()), "keys": pa.array(packed, pa.binary())})

    sent = docs.where(F.col("doc_id").isNotNull()).mapInArrow(send, SCHEMA)
    replies = sent.groupBy("bucket").applyInArrow(reply, "doc_id long, keys binary")
    return replies.groupBy("doc_id").agg(F.collect_list("keys").alias("found"))


def found_in(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a ``found`` column, and the row of each."""
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, packed in enumerate(found.to_pylist()):
        for part in packed or []:
            keys.append(np.frombuffer(part, np.uint64))
            rows.append(np.full(len(keys[-1]), i))
    return np.concatenate(keys), np.concatenate(rows)


def among(rows: np.ndarray, keys: np.ndarray, found_rows: np.ndarray, found_keys: np.ndarray) -> np.ndarray:
    """Which (row, key) pairs are among the found ones."""
    one = mix64(keys + mix64(rows.astype(np.uint64) + np.uint64(1)))
    two = mix64(found_keys + mix64(found_rows.astype(np.uint64) + np.uint64(1)))
    return np.isin(one, two)


def with_copies(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, further columns, and ``copy`` (whether a smaller id has the very same text) of the rows with an id.

    The texts are dealt out by id here, once: the later joins by id use the same exchange, as long as none of them
    filters the documents in another way. Whole texts are compared by their MD5 digest and length; groups are
    pre-aggregated, and only ids and digests are joined.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.length("text").alias("size"))
    groups = keyed.groupBy("digest", "size").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = keyed.join(groups, ["digest", "size"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))
    joined = docs.select("doc_id", "text", *others).join(copies.hint("shuffle_hash"), "doc_id", "left")
    return joined.select("doc_id", "text", *others, F.coalesce(F.array_contains("copied", F.unhex(F.md5("text"))), F.lit(False)).alias("copy"))


def with_found(docs: DataFrame, base: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, further columns, ``copy`` and ``found`` of all rows of ``docs``; rows with a null id have neither."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    joined = base.join(found.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", *others, "copy", "found")
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", "text", *others, F.lit(False).alias("copy"), F.lit(None).cast("array<binary>").alias("found"))
    return joined.unionByName(nameless)
