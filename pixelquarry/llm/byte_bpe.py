"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding: the token
``t`` whose start prefix has a last token ``u`` with ``encode(u + t) == [u, t]``. A table of these last
tokens is the whole state of the encoder. Only tokens that end at a byte are tried there; they follow from the
longest suffix of the prefix that begins a token. Appending bytes extends the table, and an edit at byte ``i``
leaves the entries before ``i`` valid, so only the rest is worked out again.

Defined results: a null or empty text has no tokens; each match of the split pattern is encoded on its
own; a piece that is itself a token is that token; special tokens don't exist. Repeated rows give
repeated rows; the other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .tables import documents
from .textbytes import byte_view, pieces

#: Bounds of what a worker keeps from task to task.
CACHE_PIECES = 300_000
CACHE_PAIRS = 300_000
CACHE_STEPS = 100_000
#: The longest parts that are kept.
CACHE_CHARS = 64
#: Bytes of text that are encoded together.
SLICE = 1_000_000
#: Above all ranks.
NEVER = 1 << 40
#: In a prefix table: before the first byte, and where no token ends.
START, NOWHERE = -1, -2
#: A state after some bytes: their longest suffix that begins a token, and the tokens that end there with their sizes, longest first.
State = tuple[bytes, tuple[tuple[int, int], ...]]


class Ranks:
    """Token ranks, with the checks and the steps that the prefix table needs."""

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        self.token = {i: t for t, i in rank.items()}
        self.size = {i: len(t) for t, i in rank.items()}
        self.base = max(self.token) + 1
        self.pairs: dict[int, bool] = {}  # by left * base + right
        self.steps: dict[bytes, State] = {}  # by the bytes of the state before and the next byte
        self._begins = {t[:k] for t in rank for k in range(1, len(t))}.difference(rank)

    @classmethod
    def parse(cls, lines: bytes) -> Ranks:
        return cls({base64.b64decode(t): int(i) for t, i in (x.split() for x in lines.splitlines() if x)})

    def merge(self, data: bytes) -> list[int]:
        """Encoding by merging the pair of lowest rank, leftmost first; for short strings."""
        rank, parts = self.rank.get, [data[i : i + 1] for i in range(len(data))]
        costs = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) != NEVER:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], NEVER)
        return [self.rank[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together; after ``START``, whether the right one does alone."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        if left == NOWHERE:
            known = False
        elif left == START:
            known = self.merge(self.token[right]) == [right]
        else:
            known = self.merge(self.token[left] + self.token[right]) == [left, right]
        self.pairs[left * self.base + right] = known
        return known

    def step(self, key: bytes) -> State:
        """The state after ``key``: the bytes of a state and one more."""
        if len(self.steps) >= CACHE_STEPS:
            self.steps.clear()
        suffix = key
        while suffix and suffix not in self.rank and suffix not in self._begins:
            suffix = suffix[1:]
        if suffix != key and suffix in self.steps:
            state = self.steps[suffix]
        else:
            ends = ((self.rank.get(suffix[k:]), len(suffix) - k) for k in range(len(suffix)))
            state = suffix, tuple((token, size) for token, size in ends if token is not None)
        self.steps[key] = state
        return state


class PrefixTable:
    """The last token of each byte prefix of one piece of text."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [START]
        self.states: list[State] = [(b"", ())]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        return self.replace(len(self.data), len(self.data), more)

    def replace(self, start: int, stop: int, new: bytes) -> PrefixTable:
        """Put ``new`` in place of ``data[start:stop]``; prefixes up to ``start`` keep their entries."""
        self.data = data = self.data[:start] + new + self.data[stop:]
        ranks, last, states = self.ranks, self.last, self.states
        del last[start + 1 :], states[start + 1 :]
        pairs, steps, base = ranks.pairs.get, ranks.steps.get, ranks.base
        state = states[start]
        for end in range(start + 1, len(data) + 1):
            key = state[0] + data[end - 1 : end]
            state = steps(key) or ranks.step(key)
            states.append(state)
            for token, size in state[1]:
                left = last[end - size]
                known = pairs(left * base + token)
                if known or (known is None and ranks.follows(left, token)):
                    last.append(token)
                    break
            else:
                last.append(NOWHERE)
        return self

    def become(self, data: bytes) -> PrefixTable:
        """The table of ``data``; prefixes that both texts have keep their entries."""
        same = 0
        for ours, other in zip(data, self.data, strict=False):
            if ours != other:
                break
            same += 1
        return self.replace(same, len(self.data), data[same:])

    def ids(self) -> list[int]:
        out, end, last, size = [], len(self.data), self.last, self.ranks.size
        if end and last[end] < 0:
            raise ValueError("the ranks lack a single-byte token")
        while end:  # what stands before a token that ends somewhere ends somewhere too
            token = last[end]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out


class Codec:
    """Encoder and decoder of whole texts, with a bounded cache of pieces and of the prefix table last worked out."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self._bytes = _by_rank(ranks.token)
        self._digits = _by_rank({i: f"{i} ".encode() for i in ranks.token})
        self._seen: dict[str, bytes] = {}  # ids as an array's bytes, which the garbage collector needn't walk through
        self._table = PrefixTable(ranks)
        self._loose = regex.compile(r" \s|\s |^ | $").search

    def piece(self, text: str) -> bytes:
        data = text.encode()
        whole = self.ranks.rank.get(data)
        ids = self._table.become(data).ids() if whole is None else [whole]
        found = array("i", ids).tobytes()
        if len(text) <= CACHE_CHARS:
            self._seen[text] = found
        return found

    def parts(self, text: str | None) -> list[str]:
        """The text in parts between which matches of the split pattern begin and end."""
        if not text:
            return []
        if self._loose(text):
            return self.split(text)
        # Each space stands between two characters that aren't spaces, so every match of the split
        # pattern lies between two such places, and what stands there can be looked up at once.
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def _part(self, part: str) -> bytes:
        seen, pieces = self._seen.get, self.split(part)
        found = b"".join([seen(p) or self.piece(p) for p in pieces])
        if len(part) <= CACHE_CHARS:
            self._seen[part] = found
        return found

    def encode(self, texts: list[str | None]) -> list[array]:
        """The ids of each text. What no text before had is worked out in order, so that neighbours share prefixes."""
        parts = [self.parts(t) for t in texts]
        new = {p for p in set(chain.from_iterable(parts)).difference(self._seen) if len(p) <= CACHE_CHARS}
        if len(self._seen) + len(new) > CACHE_PIECES:
            self._seen.clear()
        cut = {p: self.split(p) for p in new}
        for piece in sorted(set(chain.from_iterable(cut.values())).difference(self._seen)):
            self.piece(piece)
        self._seen.update((p, b"".join(map(self._seen.__getitem__, c))) for p, c in cut.items() if len(c) > 1)
        seen, out = self._seen.get, []
        for each in parts:
            ids = array("i")
            ids.frombytes(b"".join([seen(p) or self._part(p) for p in each]))
            out.append(ids)
        return out

    def decode(self, ids: list[array]) -> list[memoryview]:
        """The bytes of each text."""
        return _joined(self._bytes, ids)

    def digits(self, ids: list[array]) -> list[memoryview]:
        """The decimal ids of each text, joined by one space."""
        return [x[:-1] for x in _joined(self._digits, ids)]


def _by_rank(values: dict[int, bytes]) -> pa.Array:
    return pa.array([values.get(i) for i in range(max(values) + 1)], pa.binary())


def _joined(values: pa.Array, ids: list[array]) -> list[memoryview]:
    """For each list of ids, their values one after the other: slices of one buffer."""
    taken = values.take(pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
    raw, offsets = byte_view(taken)
    ends = offsets[np.cumsum([0, *map(len, ids)])]
    return [memoryview(raw)[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


_CODECS: dict[str, Codec] = {}


def codec_of(lines: bytes, pattern: str) -> Codec:
    """One codec for each rank file and pattern in a worker process, so that later tasks find its cache filled."""
    key = hashlib.sha256(lines + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Ranks.parse(lines), pattern)
    return _CODECS[key]


def tokens(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, the ids (if asked for), and digests of the ids and of the decoded bytes.

    The rank file is read on the driver and broadcast: its size is that of the vocabulary, whatever the
    corpus. Documents are encoded where they are read; nothing is shuffled.
    """
    with open(ranks_path, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(lines.value, pattern)
        for batch in batches:
            for piece in pieces(batch, limit=SLICE):
                encoded = codec.encode(piece.column("text").to_pylist())
                n = pa.array(map(len, encoded), pa.int64())
                ids_sha, text_sha = ([hashlib.sha256(x).hexdigest() for x in of(encoded)] for of in (codec.digits, codec.decode))
                columns = [piece.column("doc_id"), n, pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = pa.array(np.cumsum([0, *map(len, encoded)]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
