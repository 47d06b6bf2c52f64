"""Vectorised views of text columns: bytes, words and word hashes of whole Arrow batches.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Every helper works on a batch as one byte
array plus document offsets, so that the Python cost is per batch and not per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_DEPTH = 64
_TABLES = np.random.Generator(np.random.PCG64(20240611)).integers(0, 2**64, size=(2, _DEPTH * 256), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 2_000_000):
    """Zero-copy slices of a batch whose text bytes stay near ``limit`` (one document may exceed it)."""
    if not batch.num_rows:
        return
    text = batch.column(column)
    size = np.asarray(text.is_valid()).astype(np.int64)
    size[:] = np.diff(offsets_of(text))
    ends = np.cumsum(size)
    first, done = 0, 0
    while first < batch.num_rows:
        last = max(int(np.searchsorted(ends, done + limit, "right")), first + 1)
        yield batch.slice(first, last - first)
        first, done = last, int(ends[last - 1])


def offsets_of(text: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    _, offsets, _ = text.buffers()
    if offsets is None or not len(text):
        return np.zeros(len(text) + 1, dtype=np.int64)
    return np.frombuffer(offsets, dtype=wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def byte_view(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its ``n + 1`` offsets; a null is empty."""
    if text.null_count:
        text = text.fill_null("" if not pa.types.is_binary(text.type) else b"")
    offsets, data = offsets_of(text), text.buffers()[2]
    if data is None or not len(text):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(text) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


class Words:
    """Words of a batch: byte ``start`` and ``end``, ``doc`` (row in the batch), ``index`` (word number in it)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        keep = ~SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        edge[n] = True
        begins, ends = keep.copy(), keep.copy()
        if n:
            begins[1:] &= ~keep[:-1] | edge[1:n]
            ends[:-1] &= ~keep[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.index = np.arange(len(self.start), dtype=np.int64) - self.first[self.doc]
        self._keep = keep

    def hashes(self, table: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; ``table`` 0 or 1 give independent values."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        value = _TABLES[table][((place & (_DEPTH - 1)) << 8) + self.raw[self._keep]]
        if int(size.max()) > _DEPTH:
            value = value * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        return mix64(np.add.reduceat(value, first) + size.astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Word numbers at which ``width`` words of one document begin."""
        return np.flatnonzero(self.index + width <= self.count[self.doc])


def window_hashes(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive word hashes that begin at ``at``."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        out = mix64(out + words[at + k])
    return out


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[raw]
