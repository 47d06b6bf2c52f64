"""Substring dedup over words, by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document. Positions whose remainder modulo ``PERIOD`` is in
``COVER`` carry a hash of ``ANCHOR`` words. Every difference modulo the period is one of two of the cover's
remainders, so two occurrences of a window have, ``PERIOD - 1`` words or less from their start, a pair
of anchors that are aligned in both: any match of ``ANCHOR + PERIOD - 1`` words shares an anchor. Anchors that
several documents have extend to the windows around them, and these are compared by 96-bit hashes of all
their words.

Defined results: words are runs of bytes other than 0x20 and 0x09-0x0D; a null text has none; a document
with fewer words than a window loses nothing; documents with one id never count as smaller than each other,
and a null id neither loses words nor takes any; repeated rows get equal results; the document that keeps a window is the one with the
least id, so there are no ties; an empty table gives an empty one; other columns aren't read, and ``rewrite`` hands them on. A text that
a smaller id has from end to end is settled by its digest: all its windows start there too. A very long text is one array of
words, some 60 bytes a word; what is sent about it is spread over all buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .meeting import among, ask, buckets_for, found_in, with_copies, with_found
from .tables import documents, quoted
from .textbytes import Words, byte_view, pieces, window_hashes

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)  # fixed values: a difference cover modulo 7
ANCHOR = WINDOW - PERIOD + 1
ANCHOR_BYTES = 6
#: Bytes of text whose fingerprints are pre-aggregated together.
PIECE_BYTES = 2_000_000


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashes of a batch's anchors."""
    at = words.windows(ANCHOR)
    at = at[np.isin(words.index[at] % PERIOD, COVER)]
    return at, window_hashes(words.hashes(), at, ANCHOR) & np.uint64((1 << 8 * ANCHOR_BYTES) - 1)


def _own(batch: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    return Words(*byte_view(batch.column("text"))), batch.column("doc_id").to_numpy(zero_copy_only=False)


def ask_anchors(batch: pa.RecordBatch):
    words, ids = _own(batch)
    at, key = _anchors(words)
    return ids[words.doc[at]], key, None


def ask_windows(batch: pa.RecordBatch):
    """The windows of each document that begin at most ``PERIOD - 1`` words before a shared anchor."""
    words, ids = _own(batch)
    at, key = _anchors(words)
    keys, rows = found_in(batch.column("found"))
    at = at[among(words.doc[at], key, rows, keys)]
    begins = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(begins, np.maximum(at - PERIOD + 1, words.first[words.doc[at]]), 1)
    np.add.at(begins, at + 1, -1)
    near = np.flatnonzero(np.cumsum(begins[:-1]) > 0)
    near = near[words.index[near] + WINDOW <= words.count[words.doc[near]]]
    more = (window_hashes(words.hashes(1), near, WINDOW) >> np.uint64(32)).astype(np.uint32)
    return ids[words.doc[near]], window_hashes(words.hashes(), near, WINDOW), more


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with their ``copy`` mark, and for each id the windows that a smaller id has."""
    base, buckets = with_copies(docs), buckets_for(docs)
    single = base.where(~F.col("copy"))
    shared = ask(single, ask_anchors, buckets, smaller=False, key_bytes=ANCHOR_BYTES, piece_bytes=PIECE_BYTES)
    return base, ask(single.join(shared.hint("shuffle_hash"), "doc_id"), ask_windows, buckets, smaller=True, wide=True, piece_bytes=PIECE_BYTES)


def removed_words(batch: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    """The words of ``text``, and which of them go, given ``copy`` and ``found``."""
    words = Words(*byte_view(batch.column("text")))
    copy = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool)
    gone = copy[words.doc] & (words.count[words.doc] >= WINDOW)
    keys, rows = found_in(batch.column("found"))
    if len(keys):
        at = words.windows(WINDOW)
        held = np.zeros(len(words.count), dtype=bool)
        held[rows] = True
        at = at[held[words.doc[at]]]
        at = at[among(words.doc[at], window_hashes(words.hashes(), at, WINDOW), rows, keys)]
        cover = np.zeros(len(words.start) + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        gone |= np.cumsum(cover[:-1]) > 0
    return words, gone


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept`` (the words that stay, joined by spaces) of each document."""
    base, found = removals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, gone = removed_words(piece)
                raw, stays = words.raw.tobytes(), ~gone
                n_gone = np.bincount(words.doc[gone], minlength=piece.num_rows).astype(np.int64)
                kept = []
                for i in range(piece.num_rows):
                    a, b = words.first[i], words.first[i + 1]
                    s = stays[a:b]
                    kept.append(b" ".join([raw[x:y] for x, y in zip(words.start[a:b][s].tolist(), words.end[a:b][s].tolist(), strict=True)]))
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                columns = [piece.column("doc_id"), pa.array(words.count), pa.array(n_gone), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return with_found(docs, base, found).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def rewrite(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed words cut out of ``text``, each with the space after it; all columns and rows stay.

    Texts that lose nothing keep every byte. ``n_chars``, if there is such a column, counts the new text.
    """
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(quoted(c)) for c in rest]).alias("rest")) if rest else docs.select("doc_id", "text")
    base, found = removals(packed)
    fields = ["doc_id", "text", *(["rest"] if rest else [])]
    schema = with_found(packed, base, found).select(*fields).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, gone = removed_words(piece)
                text = piece.column("text")
                changed = np.unique(words.doc[gone])
                if len(changed):
                    # A removed word goes up to where the next word of its document starts, or to its end.
                    upto = np.append(words.start[1:], len(words.raw))
                    last = words.index + 1 == words.count[words.doc]
                    upto[last] = words.offsets[1:][words.doc[last]]
                    edge = np.zeros(len(words.raw) + 1, dtype=np.int64)
                    np.add.at(edge, words.start[gone], 1)
                    np.add.at(edge, upto[gone], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    new = text.to_pylist()
                    for i in changed:
                        a, b = words.offsets[i], words.offsets[i + 1]
                        new[i] = words.raw[a:b][stays[a:b]].tobytes().decode().rstrip(" \t\n\v\f\r")
                    text = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays([text if f == "text" else piece.column(f) for f in fields], fields)

    out = with_found(packed, base, found).mapInArrow(run, schema)
    named = {c: F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c) for c in columns}
    if "n_chars" in named:
        named["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(named["n_chars"])
    return out.select(*[named[c].alias(c) for c in columns])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("kept")
