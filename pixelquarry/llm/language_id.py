"""Language identification by cross-parsing.

The labelled text of each language becomes a suffix automaton. A document is parsed greedily into the
longest phrases that occur in that text, and the language with the fewest phrases, each weighed by the bits
of a pointer into its text, wins. Parsing runs over all documents of a batch at once, one byte a
step. A long text is parsed in blocks that are mended afterwards: the parse that comes over a block's edge is followed until it
begins a phrase where the block's own parse does, and from there on the two are one. So no phrase ends at an edge.

The labelled sample is one of whole rows: for each language at most ``SAMPLE_DOCS`` documents in the order of their hashes, as
many as fit in ``SAMPLE_BYTES`` and the first one anyway. No text is cut, and a language's share doesn't depend on the others.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no labelled row every
text is ``und``; a tie goes to the language first in alphabetical order; repeated rows give repeated
rows; the score is 1 minus the ratio of the best cost to the second best, or 1 if one language was learned; an empty table gives
an empty one; rows with a null language or text teach nothing; other columns aren't read; a very long text is parsed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sampling import hash_sample, held_out
from .tables import table
from .textbytes import byte_view, pieces

#: Bounds of the labelled sample: rows for each language, and bytes of text that they come to.
SAMPLE_DOCS = 64
SAMPLE_BYTES = 60_000
#: Bytes that are parsed beside each other; results don't depend on it.
BLOCK = 2048


class SuffixAutomaton:
    """All substrings of a byte string; state 0 is the start."""

    def __init__(self, data: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        nxt = self.next
        for byte in data:
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and byte not in nxt[at]:
                nxt[at][byte] = new
                at = link[at]
            if at >= 0:
                target = nxt[at][byte]
                if length[target] != length[at] + 1:
                    twin = len(nxt)
                    nxt.append(dict(nxt[target]))
                    length.append(length[at] + 1)
                    link.append(link[target])
                    link[target] = twin
                    while at >= 0 and nxt[at].get(byte) == target:
                        nxt[at][byte] = twin
                        at = link[at]
                    target = twin
                link[new] = target
            last = new


class CrossParser:
    """Transitions of all languages' automata in one displaced table; state 0 is dead.

    The edges of a state lie at ``base[state] + symbol``, in places that no other state uses; each holds its state and its target.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        used = sorted(set().union(*texts.values())) if texts else []
        self.symbol = np.zeros(256, dtype=np.int32)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.bits = np.array([np.log2(2 + len(texts[name])) for name in self.languages])
        self.root = np.zeros(len(texts), dtype=np.int32)
        rows: list[tuple[int, list[int], list[int]]] = []
        first = 1
        for k, name in enumerate(self.languages):
            edges = SuffixAutomaton(texts[name]).next
            self.root[k] = first
            rows += [(first + state, [int(self.symbol[b]) for b in out], [first + t for t in out.values()]) for state, out in enumerate(edges) if out]
            first += len(edges)
        self.base = np.zeros(first, dtype=np.int32)
        taken, entry, free, floor = bytearray(), [], 260, 260
        for state, symbols, targets in sorted(rows, key=lambda r: -len(r[1])):
            base, tried = (free if len(symbols) == 1 else floor) - symbols[0], 0
            while True:
                if len(taken) < base + 260:
                    entry.extend([0] * (len(taken) + 8192))
                    taken.extend(bytes(len(taken) + 8192))
                for c in symbols:
                    if taken[base + c]:
                        break
                else:
                    break
                base, tried = base + 1, tried + 1
            if len(symbols) == 1:
                free = base + symbols[0]  # holes are filled from the front
            elif tried > 16:
                floor += tried // 2
            self.base[state] = base
            for c, target in zip(symbols, targets, strict=True):
                taken[base + c] = 1
                entry[base + c] = state << 32 | target
        self.entry = np.array([*entry[: max((i for i in range(len(taken) - 1, -1, -1) if taken[i]), default=-1) + 1], *[0] * 260], dtype=np.int64)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        entry = self.entry[self.base[state] + symbol]
        return np.where(entry >> 32 == state, entry & 0xFFFFFFFF, 0)

    def phrases(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases for each language and document."""
        size = np.diff(offsets)
        n, symbols = len(self.languages), self.symbol[raw]
        blocks = -(-size // BLOCK)
        first_block = np.cumsum(blocks) - blocks
        doc = np.repeat(np.arange(len(size)), blocks)
        number = np.arange(len(doc)) - first_block[doc]
        start = offsets[:-1][doc] + number * BLOCK
        length = np.minimum(size[doc] - number * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        ordered = start[order]
        active = len(length) - np.searchsorted(length[order][::-1], np.arange(int(length.max()) if len(length) else 0), "right")
        state = np.repeat(self.root[:, None].astype(np.int64), len(doc), axis=1)
        nth = np.zeros((n, len(raw)), dtype=np.uint16)  # where each language's parse of a block begins a phrase, and its number
        nth[:, start] = 1
        count = np.ones((n, len(doc)), dtype=np.int32)
        for t, k in enumerate(active):
            at = ordered[:k] + t
            symbol = symbols[at]
            to = self._step(state[:, :k], symbol[None, :])
            row, col = np.nonzero(to == 0)
            if len(row):
                count[row, col] += t > 0
                nth[row, at[col]] = count[row, col]
                # A byte that the language lacks is a phrase of its own: the dead state ends it at the next byte.
                to[row, col] = self._step(self.root[row].astype(np.int64), symbol[col])
            state[:, :k] = to
        last = np.empty_like(state)
        last[:, order] = state
        blockwise = np.empty_like(count)
        blockwise[:, order] = count
        out = np.zeros((n, len(size)), dtype=np.int64)
        alone = blocks == 1
        out[:, alone] = blockwise[:, first_block[alone]]
        long = np.flatnonzero(blocks > 1)
        if len(long) and n:
            out[:, long] = blockwise[:, first_block[long]]
            self._mend(symbols, offsets, long, first_block, nth, blockwise, last, out)
        return out

    def _mend(self, symbols: np.ndarray, offsets: np.ndarray, long: np.ndarray, first_block: np.ndarray, nth: np.ndarray, count: np.ndarray, last: np.ndarray, out: np.ndarray) -> None:
        """Adds the phrases of texts of several blocks: each language's parse goes over an edge until it meets that of the block."""
        n = len(self.languages)
        lang, doc = np.repeat(np.arange(n), len(long)), np.tile(long, n)
        at, end = offsets[doc] + BLOCK, offsets[doc + 1]
        state = last[lang, first_block[doc]]
        while len(lang):
            symbol = symbols[at]
            to = self._step(state, symbol)
            cut = to == 0
            here = np.flatnonzero(cut)
            if len(here):
                to[here] = self._step(self.root[lang[here]].astype(np.int64), symbol[here])
                met = nth[lang[here], at[here]] > 0
                out[lang[here[~met]], doc[here[~met]]] += 1
                here = here[met]
            at = at + 1
            if len(here):
                begin = at[here] - 1
                block = (begin - offsets[doc[here]]) // BLOCK
                edge = np.minimum(offsets[doc[here]] + (block + 1) * BLOCK, end[here])
                number = first_block[doc[here]] + block
                out[lang[here], doc[here]] += count[lang[here], number] - nth[lang[here], begin] + 1
                at[here] = edge
                to[here] = last[lang[here], number]
            stays = at < end
            lang, doc, at, end, state = lang[stays], doc[stays], at[stays], end[stays], to[stays]

    def costs(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits for each document and language."""
        return self.phrases(raw, offsets).T * self.bits


def learn(rows: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> CrossParser:
    """A parser from ``doc_id``, ``text``, ``lang``: a bounded sample of whole labelled rows goes to the driver."""
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = hash_sample(usable.select("doc_id", "lang"), "doc_id", docs, by=["lang"])
    sample = usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "doc_id", F.lower("text").alias("text")).distinct()  # `docs` ids for each language
    so_far = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sized = sample.withColumns({"number": F.row_number().over(so_far), "bytes": F.sum(F.octet_length("text")).over(so_far)})
    texts: dict[str, list[str]] = {}
    for r in sized.where((F.col("number") == 1) | (F.col("bytes") <= size)).orderBy("lang", "number").toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"])
    return CrossParser({name: "\n".join(parts).encode() for name, parts in texts.items()})


def identify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of each whole text, worked out where the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # some 30 bytes a byte of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            for piece in pieces(batch, limit=max(24_000_000 // (len(names) + 3), 100_000)):
                text = piece.column("text").fill_null("")
                letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                best, score = np.full(len(text), len(names) - 1), np.zeros(len(text))
                if model.languages:
                    cost = model.costs(*byte_view(pc.utf8_lower(text)))
                    best = np.where(letters, cost.argmin(axis=1), best)
                    least = np.sort(cost, axis=1)
                    if cost.shape[1] > 1:
                        score = np.where(letters, 1 - least[:, 0] / np.maximum(least[:, 1], 1e-9), 0.0)
                    else:
                        score = letters.astype(np.float64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
