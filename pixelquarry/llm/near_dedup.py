"""Near-duplicate groups by b-bit MinHash.

A document is the set of its word shingles. Documents with equal sets are one class, represented by the least
id; only representatives go on. Each gets ``BANDS * ROWS`` minima: the bands' hashes propose candidates, and the
low ``BITS`` bits of each minimum, packed into longs, estimate the similarity of a pair: the share of equal codes,
corrected for codes that agree by chance. Members of a band's bucket whose estimate is within reach of the threshold
make clusters. The full shingle set of each clustered document is sent once to its cluster, and all pairs of
a cluster that no path of links joins are confirmed on these sets. Both steps work block against block inside tasks (``blocks.py``).

A pair at similarity 0.8 shares no band with a chance of about 5e-8, and its estimate falls below reach with about
1e-5; it is lost then unless other links join the two.

Defined results: words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased; a text with fewer words
than a shingle is one shingle; a null or empty text has none and is linked with nothing; rows with one id
are one node; rows with a null id are linked with nothing and kept; repeated rows get equal results; an empty table gives
an empty one; a pair at exactly ``percent`` is linked, and the least id names a group; other columns aren't read. A very long text is one
set of its distinct shingles, some 8 bytes each, and a block of its own where it passes ``BLOCK_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Kernel, blocks_of, links_within
from .tables import Scratch, documents, stored
from .textbytes import Words, byte_view, lower_ascii, mix64, pieces, window_hashes

BANDS, ROWS = 32, 4
BITS = 4
PERCENT = 80
#: How far below the threshold an estimate may lie: over four standard deviations of 128 codes at 0.8.
SLACK = 0.16
#: Bounds of what a task works out in one step: pairs of signatures, and columns of a 0-1 matrix.
PAIRS_AT_ONCE = 200_000
COLUMNS_AT_ONCE = 4096

_rng = np.random.Generator(np.random.PCG64(99))
_TIMES = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of the distinct shingles of each text, sorted by both."""
    raw, offsets = byte_view(text)
    words = Words(lower_ascii(raw), offsets)
    hashes = words.hashes()
    at = words.windows(shingle)
    row, key = [words.doc[at]], [window_hashes(hashes, at, shingle)]
    for n in range(1, shingle):
        short = words.first[:-1][words.count == n]
        row.append(words.doc[short])
        key.append(mix64(window_hashes(hashes, short, n) + np.uint64(n)))
    rows, keys = np.concatenate(row), np.concatenate(key)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, a 128-bit digest of the set, the hashes of its bands, and its packed low bits."""
    names = ["doc_id", "n_shingles", "digest", "bands", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=1_000_000):
                n = piece.num_rows
                rows, keys = shingle_sets(piece.column("text"), shingle)
                size = np.bincount(rows, minlength=n).astype(np.int64)
                some = np.flatnonzero(size)
                first = (np.cumsum(size) - size)[some]
                minima = np.zeros((n, BANDS * ROWS), dtype=np.uint64)
                digest = np.zeros((n, 2), dtype=np.uint64)
                if len(some):
                    for k in range(BANDS * ROWS):
                        minima[some, k] = np.minimum.reduceat(keys * _TIMES[k] + _PLUS[k], first)
                    digest[some, 0] = np.add.reduceat(mix64(keys ^ _PLUS[0]), first)
                    digest[some, 1] = np.add.reduceat(mix64(keys ^ _PLUS[1]), first)
                band = np.zeros((n, BANDS), dtype=np.uint64)
                for k in range(ROWS):
                    band = mix64(band * np.uint64(31) + minima[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
                # The top bits order the minima; the low ones that b-bit codes keep come from a mix of them.
                low = mix64(minima) & np.uint64((1 << BITS) - 1)
                codes = np.zeros((n, BANDS * ROWS * BITS // 64), dtype=np.uint64)
                for k in range(BANDS * ROWS):
                    place = k * BITS
                    codes[:, place // 64] |= low[:, k] << np.uint64(place % 64)
                packed = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (band, codes)]
                digests = pa.array([x.tobytes() for x in digest], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size), digests, *packed], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, codes array<long>")


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of packed signatures: the share of equal codes, less what agrees by chance."""
    bits = a ^ b
    for step in (2, 1):  # a code differs where any of its bits does
        bits |= bits >> np.uint64(step)
    differing = np.bitwise_count(bits & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - differing / (BANDS * ROWS) - chance) / (1 - chance)


def likely_pairs(percent: int) -> Kernel:
    """Pairs within groups whose set sizes and estimated similarity are within reach of ``percent``."""

    def kernel(table: pa.Table, first: np.ndarray, own: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes = table.column("codes").chunk(0).flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
        size = table.column("n_shingles").to_numpy()
        end = np.append(first, table.num_rows)[1:]
        row = np.arange(table.num_rows)
        group = np.searchsorted(first, row, "right") - 1
        partners = np.where(row - first[group] < own[group], end[group] - row - 1, 0)  # of each row of role 0, those after it
        total = np.cumsum(partners)
        at = 0
        while at < len(row):
            upto = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")), at + 1)
            n = partners[at:upto]
            a = np.repeat(row[at:upto], n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            near = (label[a] != label[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
            a, b = a[near], b[near]
            near = estimates(codes[a], codes[b]) >= percent / 100 - SLACK
            yield a[near], b[near]
            at = upto

    return kernel


def similar_pairs(percent: int) -> Kernel:
    """Pairs within groups whose full shingle sets are similar enough: intersections by products of 0-1 matrices."""

    def kernel(table: pa.Table, first: np.ndarray, own: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        packed = table.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(packed), dtype=np.uint64)
        size = np.array([len(x) for x in packed], dtype=np.int64) // 8
        bound = np.concatenate(([0], np.cumsum(size)))
        for a, n, z in zip(first, own, np.append(first, table.num_rows)[1:], strict=True):
            if not n or z - a < 2:
                continue
            _, code, times = np.unique(keys[bound[a] : bound[z]], return_inverse=True, return_counts=True)
            several = times > 1
            column_of = np.cumsum(several) - 1
            entry = np.flatnonzero(several[code])
            row, col = np.repeat(np.arange(z - a), size[a:z])[entry], column_of[code[entry]]
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            both = np.zeros((n, z - a), dtype=np.float32)
            for low in range(0, int(several.sum()), COLUMNS_AT_ONCE):
                i, j = np.searchsorted(col, (low, low + COLUMNS_AT_ONCE))
                dense = np.zeros((z - a, COLUMNS_AT_ONCE if j - i > COLUMNS_AT_ONCE else max(int(col[j - 1]) - low + 1, 1)), dtype=np.float32)
                dense[row[i:j], col[i:j] - low] = 1
                both += dense[:n] @ dense.T
            shared = both.astype(np.int64)
            near = (shared > 0) & (100 * shared >= percent * (size[a : a + n, None] + size[None, a:z] - shared))
            near &= label[a : a + n, None] != label[None, a:z]
            x, y = np.nonzero(near)
            yield a + x, a + y

    return kernel


def shingle_keys(texts: DataFrame, shingle: int) -> DataFrame:
    """``keys`` (the sorted 64-bit hashes of the shingle set, packed) in the place of ``text``; other columns stay."""
    others = [c for c in texts.columns if c != "text"]
    schema = texts.select(*others).schema.add("keys", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=1_000_000):
                rows, keys = shingle_sets(piece.column("text"), shingle)
                at = np.searchsorted(rows, np.arange(piece.num_rows + 1))
                packed = pa.array([keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in others], packed], [*others, "keys"])

    return texts.mapInArrow(run, schema)


def clusters_of(codes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``node`` and ``label``: components of the representatives whose signatures share a band and are within reach."""
    buckets = codes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))  # the hash tells bands apart
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"))
    # Of buckets with the same members one is enough.
    heads = heads.where("first < last").groupBy("first", "last", "n", "one", "two").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    shared = buckets.join(heads, "bucket").select(F.col("bucket").alias("grp"), "node", blocks_of(F.col("n"), F.lit(0)).alias("blocks"))
    members = scratch.stored(shared.join(codes.select(F.col("doc_id").alias("node"), "n_shingles", "codes"), "node"), "buckets")
    return links_within(members, likely_pairs(percent), scratch, "likely")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row."""
    signed = stored(signatures(docs, shingle), "signatures")
    usable = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("representative")), "classes")
    with Scratch(docs.sparkSession, "near-dedup") as scratch:
        chosen = usable.join(classes.select("digest", F.col("representative").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
        codes = scratch.stored(chosen.select("doc_id", "n_shingles", "codes", "bands"), "representatives")
        clusters = clusters_of(codes, scratch, percent)
        sized = clusters.join(codes.select(F.col("doc_id").alias("node"), "n_shingles"), "node").select("node", F.col("label").alias("grp"), "n_shingles")
        counts = sized.groupBy("grp").agg(blocks_of(F.count("*"), 8 * F.sum("n_shingles")).alias("blocks"))
        named = sized.select("node", "grp").distinct().join(counts, "grp")
        texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("node"), "text").join(named.hint("shuffle_hash"), "node")
        sets = scratch.stored(shingle_keys(texts, shingle), "sets")
        found = links_within(sets, similar_pairs(percent), scratch, "similar")
    member = signed.join(classes, "digest", "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("representative")).otherwise(F.col("doc_id")).alias("node"))
    named = member.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=2)
