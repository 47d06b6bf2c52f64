"""Substring dedup over bytes, by suffix arrays built column by column.

All ``LENGTH``-byte strings with the same minimiser (the least hash of their ``SEED``-byte parts) meet in one
bucket: a text is cut into maximal runs of strings that have theirs at the same place, at most ``RUN`` of them. Runs whose
minimiser no other document has are left out, and so are those that agree with no other run in the bytes beside it. The
runs left are a collection of short texts, and its suffixes are sorted the Bauer-Cox-Rosone way: each round inserts one symbol of every
text, from its end, into the Burrows-Wheeler transform, and carries the common prefixes along. The
rounds are as many as the longest run has bytes, whatever the lengths of the documents. Suffixes that follow each other with ``LENGTH``
bytes in common are the repeated strings.

The method's external files are the shuffle's own blocks here: a bucket is read in one sequence, the number of buckets follows
the texts' bytes, and a task sorts ``COLLECTION`` runs at a time. Whole documents with equal texts, and equal runs, are settled by hashes before.

Defined results: a null text has no bytes; matches don't cross documents; texts shorter than ``LENGTH`` lose
nothing; documents with one id never count as smaller than each other; a null id neither loses nor takes; repeated rows get equal results; the
document that keeps a string is the one with the least id, so there are no ties; an empty table gives an empty one; other columns
aren't read. Very long texts are worked on in stretches; beside the text a task holds some 4 bytes a byte of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .meeting import ask, buckets_for, with_copies, with_found
from .tables import documents
from .textbytes import byte_view, mix64, pieces

LENGTH = 50
SEED = 24
RUN = LENGTH - SEED + 1  # strings that can share one minimiser's place
HALF = (LENGTH - SEED) // 2
SEED_BYTES = 6
#: Bytes worked on at a time, whatever the texts' lengths, and the bits that number the places among them.
STRETCH, PLACE_BITS = 1 << 16, 17
#: Runs whose suffixes are sorted together, as far as minimisers allow.
COLLECTION = 4000

_TABLE = np.random.Generator(np.random.PCG64(50)).integers(0, 2**64, size=(3, 256), dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C13, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)  # 3 modulo 4
_POWER = np.ones((3, STRETCH + 2 * LENGTH), dtype=np.uint64)
_POWER[:, 1:] = _ODD[:, None]
_POWER = np.cumprod(_POWER, axis=1, dtype=np.uint64)
_INVERSE = np.ones_like(_POWER)
_INVERSE[:, 1:] = np.array([pow(int(x), -1, 2**64) for x in _ODD], dtype=np.uint64)[:, None]
_INVERSE = np.cumprod(_INVERSE, axis=1, dtype=np.uint64)


def _sums(raw: np.ndarray, table: int) -> np.ndarray:
    """Prefix sums from which ``_between`` takes the hash of any part."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[table][raw] * _POWER[table, : len(raw)], out=out[1:])
    return out


def _between(sums: np.ndarray, first: np.ndarray, end: np.ndarray, table: int) -> np.ndarray:
    return mix64((sums[end] - sums[first]) * _INVERSE[table, first] + (end - first).astype(np.uint64))


class Runs:
    """Runs of a batch: row ``doc``, first byte ``start``, ``count`` of strings, minimiser ``key``, its ``place`` in the run, two hashes.

    A run's strings have their minimiser, the leftmost least one, at the same place of the text. Bytes are looked at in
    stretches, so memory beyond a flag or two a byte doesn't grow with the texts.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = max(len(raw) - LENGTH + 1, 0)
        inside = np.zeros(n + 1, dtype=np.int8)
        long = np.diff(offsets) >= LENGTH
        inside[offsets[:-1][long]] += 1
        inside[offsets[1:][long] - LENGTH + 1] -= 1
        inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
        parts = [[np.zeros(0, k)] for k in (np.int64, np.uint64, np.int64)]
        before = -1
        for low in range(0, n, STRETCH):
            place, key = self._minimisers(raw[low : low + STRETCH + LENGTH - 1])
            place += low
            m = len(place)
            new = inside[low : low + m].copy()
            new[1:] &= (place[1:] != place[:-1]) | ~inside[low : low + m - 1]
            if low:
                new[0] &= place[0] != before or not inside[low - 1]
            before = place[-1]
            at = np.flatnonzero(new)
            for part, x in zip(parts, (at + low, key[at], place[at] - at - low), strict=True):
                part.append(x)
        self.start, self.key, self.place = (np.concatenate(x) for x in parts)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        # A run lasts to the next one, or to the last string of its document.
        upto = offsets[self.doc + 1] - LENGTH + 1
        upto[:-1] = np.minimum(upto[:-1], self.start[1:])
        self.count = upto - self.start
        self.hash, self.more = np.zeros(len(upto), np.uint64), np.zeros(len(upto), np.uint64)
        for low in range(0, n, STRETCH):
            i, j = np.searchsorted(self.start, (low, low + STRETCH))
            piece = raw[low : low + STRETCH + 2 * LENGTH]
            first = self.start[i:j] - low
            end = first + self.count[i:j] + LENGTH - 1
            self.hash[i:j] = _between(_sums(piece, 1), first, end, 1)
            self.more[i:j] = _between(_sums(piece, 2), first, end, 2)

    @staticmethod
    def _minimisers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each string of a stretch the place and the hash of its leftmost least part of SEED bytes."""
        sized = {1: _TABLE[0][raw]}
        for k in (1, 2, 4, 8):
            sized[2 * k] = sized[k][:-k] * _POWER[0, k] + sized[k][k:]
        part = sized[16][: len(raw) - SEED + 1] * _POWER[0, 8] + sized[8][16:]
        part *= np.uint64(0xD6E8FEB86659FD93)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0x9E3779B97F4A7C15)
        least = part & ~np.uint64((1 << PLACE_BITS) - 1) | np.arange(len(part), dtype=np.uint64)
        done = 1
        while 2 * done <= RUN:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        least = np.minimum(least[: len(least) - (RUN - done)], least[RUN - done :])
        return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), least >> np.uint64(PLACE_BITS)

    def take(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some runs, one after the other, and their lengths."""
        start, size = self.start[mask], self.count[mask] + LENGTH - 1
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum()) if len(size) else 0) + np.repeat(start - first, size)
        return self.raw[at], size


def with_shared_context(ids: np.ndarray, key: np.ndarray, place: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which runs can have a string in common with a run of another id.

    Equal strings have the minimiser at the same place, and it has at least HALF bytes of the string to its left or to
    its right. So the two runs agree in the minimiser and HALF bytes on one side of it.
    """
    first = np.cumsum(size) - size
    keep = np.zeros(len(size), dtype=bool)
    for shift in (-HALF, SEED):
        low = first + place + shift
        has = np.flatnonzero((low >= first) & (low + HALF <= first + size))
        beside = np.zeros(len(has), dtype=np.uint64)
        for k in range(HALF):
            beside = beside * _ODD[1] + _TABLE[1][text[low[has] + k]]
        mixed = mix64(mix64(beside) + key[has])
        order = np.argsort(mixed)
        cut = np.flatnonzero(np.concatenate(([True], mixed[order][1:] != mixed[order][:-1]))) if len(has) else np.zeros(0, np.int64)
        if len(cut):
            least, most = np.minimum.reduceat(ids[has][order], cut), np.maximum.reduceat(ids[has][order], cut)
            keep[has[order]] |= np.repeat(least < most, np.diff(np.append(cut, len(has))))
    return keep


def run_hashes(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the texts that lie one after the other, independent of ``Runs.hash``."""
    first = np.cumsum(size) - size
    place = np.arange(len(text)) - np.repeat(first, size)
    return mix64(np.add.reduceat(_TABLE[2][text] * _POWER[2, place], first) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)


_BLOCK = 16


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each pair; 255 where that is empty."""
    rows = -(-len(values) // _BLOCK)
    padded = np.full(rows * _BLOCK, 255, dtype=np.uint8)
    padded[: len(values)] = values
    least = padded
    while len(least) > rows:
        least = np.minimum(least[0::2], least[1::2])
    levels = [least]
    while 2 ** len(levels) <= rows:
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    out = np.full(len(low), 255, dtype=np.uint8)
    first = np.minimum(low // _BLOCK, rows - 1)
    last = np.maximum((high - 1) // _BLOCK, first)
    for block, begin, end in ((first, low, np.minimum(high, (first + 1) * _BLOCK)), (last, np.maximum(low, last * _BLOCK), high)):
        base = block * _BLOCK
        for step in range(_BLOCK):
            at = base + step
            np.minimum(out, padded[at], out=out, where=(at >= begin) & (at < end))
    inner = np.flatnonzero(last - first > 1)
    if len(inner):
        size = last[inner] - first[inner] - 1
        level = np.log2(size).astype(np.int64)
        for k in np.unique(level):
            which = inner[level == k]
            least = np.minimum(levels[k][first[which] + 1], levels[k][last[which] - 2**k])
            out[which] = np.minimum(out[which], least)
    return out


def sorted_suffixes(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of a collection in order: number of the text, length, and common prefix with the one before.

    Equal suffixes keep the order of their texts. Each round inserts into the transform, for every text that has one, the
    suffix that is one symbol longer: its place follows from the rank of its first symbol before the place of
    the suffix of the round before. Its common prefix with the suffix before it is one more than that of their tails, the
    least common prefix from the symbol's last occurrence up to here; the suffix after it likewise. At the end
    the places of each text's suffixes are read off by following the ranks.
    """
    n, end = len(size), np.cumsum(size)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    used, code = np.unique(text, return_inverse=True)
    code = (code + 1).astype(np.uint8)  # 0 ends a text; UTF-8 leaves more than one byte value free
    symbols = len(used) + 1
    transform, at, active, common = code[end - 1], np.arange(n), np.arange(n), np.zeros(n, dtype=np.uint8)
    for length in range(1, int(size.max()) + 1):
        occurs = np.argsort(transform, kind="stable")  # by symbol, then by place
        counts = np.bincount(transform, minlength=symbols)
        begin = np.cumsum(counts) - counts
        asked = np.zeros(len(transform), dtype=bool)
        asked[at] = True
        index = np.flatnonzero(asked[occurs])
        order = np.argsort(at)
        order = order[np.argsort(transform[at[order]], kind="stable")]
        at, active = at[order], active[order]
        symbol = transform[at].astype(np.int64)
        rank = index - begin[symbol]
        some = np.concatenate(([n], counts[1:]))
        place = (np.cumsum(some) - some)[symbol] + rank
        # Tails of the neighbours that begin with the same symbol: its occurrences before and after this one.
        before = np.where(rank > 0, occurs[np.maximum(index - 1, 0)], -1)
        after = np.where(rank + 1 < counts[symbol], occurs[np.minimum(index + 1, len(occurs) - 1)], -1)
        low = np.concatenate((np.where(before >= 0, before, at) + 1, at + 1))
        least = _range_minima(common, low, np.concatenate((at + 1, np.where(after >= 0, after, at) + 1)))
        with_before = np.where(before >= 0, least[: len(at)] + 1, 0)
        with_after = np.where(after >= 0, least[len(at) :] + 1, 0)
        new = np.where(size[active] > length, code[end[active] - np.minimum(length + 1, size[active])], np.uint8(0))
        old = np.ones(len(transform) + len(place), dtype=bool)
        old[place] = False
        grown, shared = np.empty(len(old), dtype=np.uint8), np.empty(len(old) + 1, dtype=np.uint8)
        grown[old], shared[:-1][old] = transform, common
        shared[place + 1] = with_after
        grown[place], shared[place] = new, with_before
        transform, common = grown, shared[:-1]
        at, active = place[new > 0], active[new > 0]
    follow = np.empty(len(transform), dtype=np.int64)
    follow[np.argsort(transform, kind="stable")] = np.arange(len(transform))  # the texts' ends come first, as do the empty suffixes
    who, lengths = np.empty(len(transform), np.int64), np.empty(len(transform), np.int64)
    at, active = np.arange(n), np.arange(n)
    for length in range(int(size.max()) + 1):
        who[at], lengths[at] = active, length
        longer = size[active] > length
        at, active = follow[at[longer]], active[longer]
    return who, lengths, common


def repeated(ids: np.ndarray, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and offset of each string of LENGTH bytes that a text with a smaller id has too."""
    who, length, common = sorted_suffixes(text, size)
    whole = length >= LENGTH  # no shorter suffix lies between two with LENGTH bytes in common
    who, length, same = who[whole], length[whole], common[whole] >= LENGTH
    if not len(who):
        return who, length
    first = np.flatnonzero(~same)
    least = np.minimum.reduceat(ids[who], first)
    again = ids[who] > np.repeat(least, np.diff(np.append(first, len(who))))
    return who[again], size[who[again]] - length[again]


def ask_seeds(batch: pa.RecordBatch):
    runs = Runs(*byte_view(batch.column("text")))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    return ids[runs.doc], runs.key, None


def _keys_of(found: pa.Array, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The records of ``step`` bytes of a ``found`` column, and the row of each."""
    parts, rows = [np.zeros((0, step), np.uint8)], [np.zeros(0, np.int64)]
    for i, packed in enumerate(found.to_pylist()):
        for part in packed or []:
            parts.append(np.frombuffer(part, np.uint8).reshape(-1, step))
            rows.append(np.full(len(parts[-1]), i))
    return np.concatenate(parts), np.concatenate(rows)


def _pair(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix64(keys + mix64(rows.astype(np.uint64) + np.uint64(1)))


def _records(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Replies: run hash, first and last offset of a stretch of repeated strings; ten bytes each."""
    out = np.zeros((len(keys), 10), dtype=np.uint8)
    out[:, :8] = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[:, 8], out[:, 9] = low, high
    return out


def repeats(docs: DataFrame, buckets: int) -> DataFrame:
    """``doc_id`` and ``found``: for each id the stretches of its runs that a smaller id has, by run hash."""
    seeds = ask(docs, ask_seeds, buckets, smaller=False, key_bytes=SEED_BYTES)
    names = ["bucket", "settled", "ids", "keys", "sizes", "bytes"]

    def equal_runs(ids: np.ndarray, key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal runs the one with the least id, and which of the others have a larger one."""
        order = np.lexsort((ids, more, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
        least = ids[order][new][np.cumsum(new) - 1]
        return order[new], order[ids[order] > least]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=4_000_000):
                runs = Runs(*byte_view(piece.column("text")))
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
                keys, rows = _keys_of(piece.column("found"), 8)
                mask = np.isin(_pair(runs.doc, runs.key), _pair(rows, keys.view("<u8").ravel()))
                if not mask.any():
                    continue
                at = np.flatnonzero(mask)
                own, seed, size = ids[runs.doc[at]], runs.key[at], runs.count[at] + LENGTH - 1
                key, more, place = runs.hash[at], runs.more[at], runs.place[at].astype(np.uint8)
                goes, known = equal_runs(own, key, more)
                out = []
                # What a smaller document of this piece has is settled; it is spread by id and only passes through.
                spread = (mix64(own[known].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(spread):
                    k = known[spread == b]
                    out.append((int(b), True, own[k].tobytes(), _records(key[k], 0 * size[k], size[k] - LENGTH).tobytes(), b"", b""))
                home = (mix64(seed[goes]) % np.uint64(buckets)).astype(np.int64)
                turn = np.argsort(home, kind="stable")
                goes, home = goes[turn], home[turn]
                text, _ = runs.take(at[goes])
                first = np.concatenate(([0], np.cumsum(size[goes])))
                cut = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
                for a, b in zip(cut, [*cut[1:], len(home)], strict=True):
                    k = goes[a:b]
                    fields = np.column_stack((seed[k].view(np.uint8).reshape(-1, 8)[:, :SEED_BYTES], place[k], size[k].astype(np.uint8)))
                    out.append((int(home[a]), False, own[k].tobytes(), key[k].tobytes(), fields.tobytes(), text[first[a] : first[b]].tobytes()))
                kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def reply(table: pa.Table) -> pa.Table:
        rows = list(zip(*[table.column(c).to_pylist() for c in names[1:]], strict=True))
        told = [np.frombuffer(r[1], np.int64) for r in rows if r[0]]
        records = [np.frombuffer(r[2], np.uint8).reshape(-1, 10) for r in rows if r[0]]
        sent = [r for r in rows if not r[0]]
        if sent:
            ids = np.concatenate([np.frombuffer(r[1], np.int64) for r in sent])
            key = np.concatenate([np.frombuffer(r[2], np.uint64) for r in sent])
            fields = np.concatenate([np.frombuffer(r[3], np.uint8).reshape(-1, SEED_BYTES + 2) for r in sent])
            text = np.concatenate([np.frombuffer(r[4], np.uint8) for r in sent])
            place, size = fields[:, SEED_BYTES].astype(np.int64), fields[:, SEED_BYTES + 1].astype(np.int64)
            seed = np.zeros((len(size), 8), dtype=np.uint8)
            seed[:, :SEED_BYTES] = fields[:, :SEED_BYTES]
            seed = seed.view("<u8").ravel()
            first = np.cumsum(size) - size
            once, again = equal_runs(ids, key, run_hashes(text, size))
            told.append(ids[again])  # the same run in a document with a smaller id: all of it goes
            records.append(_records(key[again], 0 * again, size[again] - LENGTH))

            def taken(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                n = size[which]
                return text[np.arange(int(n.sum())) + np.repeat(first[which] - (np.cumsum(n) - n), n)], n

            once = once[with_shared_context(ids[once], seed[once], place[once], *taken(once))]
            once = once[np.argsort(seed[once], kind="stable")]
            # Runs with different minimisers have no string in common: collections of whole groups are sorted one by one.
            new = np.flatnonzero(np.concatenate(([True], seed[once][1:] != seed[once][:-1]))) if len(once) else np.zeros(0, np.int64)
            cut = new[np.flatnonzero(np.diff(new // COLLECTION, prepend=-1))]
            for a, b in zip(cut, np.append(cut, len(once))[1:], strict=True):  # none, where no run is left
                part = once[a:b]
                who, offset = repeated(ids[part], *taken(part))
                order = np.lexsort((offset, who))
                who, offset = who[order], offset[order]
                new = np.ones(len(who), dtype=bool)
                new[1:] = (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1)
                low = np.flatnonzero(new)
                high = np.append(low, len(who))[1:] - 1
                told.append(ids[part][who[low]])
                records.append(_records(key[part][who[low]], offset[low], offset[high]))
        ids = np.concatenate([np.zeros(0, np.int64), *told])
        record = np.concatenate([np.zeros((0, 10), np.uint8), *records])
        order = np.argsort(ids, kind="stable")
        ids, record = ids[order], record[order]
        cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(cut, len(ids))[1:] if len(ids) else cut
        packed = [record[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
        return pa.table({"doc_id": pa.array(ids[cut], pa.int64()), "keys": pa.array(packed, pa.binary())})

    sent = docs.join(seeds.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "found").mapInArrow(send, "bucket int, settled boolean, ids binary, keys binary, sizes binary, bytes binary")
    replies = sent.groupBy("bucket").applyInArrow(reply, "doc_id long, keys binary")
    return replies.groupBy("doc_id").agg(F.collect_list("keys").alias("found"))


def removed_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of ``text``, their offsets, and which of them go, given ``copy`` and ``found``."""
    raw, offsets = byte_view(batch.column("text"))
    size = np.diff(offsets)
    copy = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool)
    gone = np.repeat(copy & (size >= LENGTH), size)
    records, rows = _keys_of(batch.column("found"), 10)
    if len(rows):
        runs = Runs(raw, offsets)
        held = np.zeros(len(size), dtype=bool)
        held[rows] = True
        mask = held[runs.doc]
        own = _pair(runs.doc[mask], runs.hash[mask])
        told = _pair(rows, np.ascontiguousarray(records[:, :8]).view("<u8").ravel())
        order = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[order], told, "left"), np.searchsorted(own[order], told, "right")
        n = high - low  # a run may occur several times in its document
        which = order[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)]
        start = runs.start[mask][which]
        cover = np.zeros(len(raw) + 1, dtype=np.int64)
        np.add.at(cover, start + np.repeat(records[:, 8].astype(np.int64), n), 1)
        np.add.at(cover, start + np.repeat(records[:, 9].astype(np.int64), n) + LENGTH, -1)
        gone |= np.cumsum(cover[:-1]) > 0
    return raw, offsets, gone


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the bytes that stay) of each document."""
    base = with_copies(docs)
    found = repeats(base.where(~F.col("copy")), buckets_for(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                raw, offsets, gone = removed_bytes(piece)
                sums = np.concatenate(([0], np.cumsum(gone)))
                doc = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
                opens = gone.copy()
                opens[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
                spans = np.bincount(doc[opens], minlength=piece.num_rows).astype(np.int64)
                kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                columns = [piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]]), pa.array(spans), pa.array(sha), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return with_found(docs, base, found).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("kept")
