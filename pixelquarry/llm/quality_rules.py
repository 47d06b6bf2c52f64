"""Quality rules on whole texts, and an isolation forest over their statistics.

The rules count words, symbols, repeated lines and repeated word windows. The forest isolates documents by
random splits of these statistics: the shorter the mean path to a document's leaf, the more unusual it
is. Every tree is grown over all labelled documents that pass the base rules, level by level: each level is one
job that finds the bounds of all nodes. The path score above which a document goes is an exact quantile over all
labelled good ones.

Defined results: a null or empty text has zero words and fails the base rules; without labelled rows no
document goes by the forest; a null or repeated id is an ordinary row (it takes part in the fit once for each
document row; of several labels of an id the least counts, a null id has none); other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, table
from .textbytes import SPACE, Words, byte_view, mix64, pieces, window_hashes

#: Trees of the forest, and the splits on a path at most.
TREES, DEPTH = 100, 8
#: Bits of a score that one pass of the quantile settles.
RADIX_BITS = 16
#: Share of the labelled good documents that the calibrated threshold may reject.
GOOD_LOSS = 0.015
SYMBOLS = b"#*$%&|<>"
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VIEW = ["chars", "symbols", "repeats", "stops"]


def _dup_lines(raw: np.ndarray, offsets: np.ndarray, docs: int) -> np.ndarray:
    """For each document: lines with a word that equal an earlier line."""
    if not len(raw):
        return np.zeros(docs, dtype=np.int64)
    apart = np.where(raw == 10, np.uint8(32), np.uint8(65))  # lines as the words of a text whose only space is \n
    spans = Words(apart, offsets)
    spans.raw = raw
    total = np.concatenate(([0], np.cumsum(~SPACE[raw])))
    worded = total[spans.end] - total[spans.start]
    key = spans.hashes()[worded > 0]
    doc = spans.doc[worded > 0]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][same], minlength=docs).astype(np.int64)


def statistics(text: pa.Array) -> dict[str, np.ndarray]:
    """The rules' counts, and further ones for the forest, for each text."""
    raw, offsets = byte_view(text)
    docs = len(text)
    words = Words(raw, offsets)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    keep = words._keep
    out = {"n_words": words.count, "word_chars": total(keep & ((raw & 0xC0) != 0x80))}
    out["n_symbols"] = total(np.isin(raw, np.frombuffer(SYMBOLS, dtype=np.uint8)))
    out["n_dup_lines"] = _dup_lines(raw, offsets, docs)
    at = words.windows(3)
    key, doc = window_hashes(words.hashes(), at, 3), words.doc[at]
    mixed = mix64(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    same = (mixed[order][1:] == mixed[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    repeated = np.zeros(len(at), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(len(words.start), dtype=bool)
    for k in range(3):
        covered[at[repeated] + k] = True
    out["n_repeat_words"] = np.bincount(words.doc[covered], minlength=docs).astype(np.int64)
    out["n_stops"] = total(raw == ord("."))
    return out


def ratios(s: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's view of the counts, by rates: characters, symbols, repeated words and full stops for each word."""
    n = np.maximum(s["n_words"], 1)
    return np.column_stack([s["word_chars"] / n, s["n_symbols"] / n, s["n_repeat_words"] / n, s["n_stops"] / n]).astype(np.float64)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of ``n`` rows."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


class IsolationForest:
    """Trees of random splits, each over all rows; node ``h`` of a tree has the children ``2 * h`` and ``2 * h + 1``, the root is 1."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        self.trees, self.depth, self.seed, self.size = trees, depth, seed, 0
        self.feature = np.zeros((trees, 2 << depth), dtype=np.int64)
        self.cut = np.full((trees, 2 << depth), np.nan)  # NaN at a leaf
        self.path = np.zeros((trees, 2 << depth))
        for level in range(depth + 1 if len(rows) else 0):
            self.split(level, *self.bounds(level, rows))

    def _nodes(self, tree: int, rows: np.ndarray, level: int) -> np.ndarray:
        """The node of each row after ``level`` splits, or the leaf before."""
        at, each = np.ones(len(rows), dtype=np.int64), np.arange(len(rows))
        for _ in range(level):
            cut = self.cut[tree, at]
            at = np.where(np.isnan(cut), at, 2 * at + (rows[each, self.feature[tree, at]] >= cut))
        return at

    def bounds(self, level: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each tree and node of a level: how many rows reach it, and each feature's least and greatest value there."""
        width = 1 << level
        n, low, high = np.zeros((self.trees, width), dtype=np.int64), *(np.full((rows.shape[1], self.trees, width), v) for v in (np.inf, -np.inf))
        for tree in range(self.trees):
            at = self._nodes(tree, rows, level) - width
            there = at >= 0
            at = at[there]
            n[tree] = np.bincount(at, minlength=width)
            for k in range(rows.shape[1]):
                np.minimum.at(low[k, tree], at, rows[there, k])
                np.maximum.at(high[k, tree], at, rows[there, k])
        return n, low, high

    def split(self, level: int, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Split the nodes of a level at random: a feature that varies there, and a cut between its bounds."""
        here = slice(1 << level, 2 << level)
        self.path[:, here] = level + _mean_path(n)
        if level == 0:
            self.size = int(n[0, 0])
        if level == self.depth:
            return
        draw = np.random.Generator(np.random.PCG64([self.seed, level])).random((2, self.trees, 1 << level))
        wide = high > low
        order = np.cumsum(wide, axis=0)  # the number of each varying feature among those of its node, from 1
        chosen = np.argmax(wide & (order == np.floor(draw[0] * order[-1]) + 1), axis=0)
        least, most = (np.take_along_axis(v, chosen[None], axis=0)[0] for v in (low, high))
        inner = wide.any(axis=0)
        self.feature[:, here] = chosen
        self.cut[:, here][inner] = most[inner] - (most[inner] - least[inner]) * draw[1][inner]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; near 1 for rows that few splits isolate."""
        if not self.size or not len(rows):
            return np.zeros(len(rows))
        path = np.zeros(len(rows))
        for tree in range(self.trees):
            path += self.path[tree, self._nodes(tree, rows, self.depth)]
        return 2.0 ** (-path / self.trees / max(float(_mean_path(self.size)), 1e-9))


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def passing(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the forest's view of every document that passes the base rules, in one pass where the text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                s = statistics(piece.column("text"))
                passed = ~base_failed(s)
                columns = [piece.column("doc_id").filter(pa.array(passed)), *map(pa.array, ratios(s)[passed].T)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *VIEW])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} double" for k in VIEW))


def _view(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy() for k in VIEW])


def grow(rows: DataFrame, **shape: int) -> IsolationForest:
    """The forest over all ``rows``. What reaches the driver are the nodes of a level, ``TREES * 2**DEPTH`` at most."""
    forest = IsolationForest(np.zeros((0, len(VIEW))), **shape)
    lows, highs = [f"low{k}" for k in range(len(VIEW))], [f"high{k}" for k in range(len(VIEW))]
    merged = [F.sum("n").alias("n"), *[F.min(k).alias(k) for k in lows], *[F.max(k).alias(k) for k in highs]]
    for level in range(forest.depth + 1):
        so_far = rows.sparkSession.sparkContext.broadcast(forest)

        def run(batches: Iterator[pa.RecordBatch], level: int = level, so_far=so_far) -> Iterator[pa.RecordBatch]:
            n, low, high = so_far.value.bounds(level, np.zeros((0, len(VIEW))))
            for batch in batches:
                more = so_far.value.bounds(level, _view(batch))
                n, low, high = n + more[0], np.minimum(low, more[1]), np.maximum(high, more[2])
            node = np.flatnonzero(n)
            columns = [node, n.ravel()[node], *low.reshape(len(VIEW), -1)[:, node], *high.reshape(len(VIEW), -1)[:, node]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["node", "n", *lows, *highs])

        schema = "node long, n long, " + ", ".join(f"{k} double" for k in lows + highs)
        got = rows.mapInArrow(run, schema).groupBy("node").agg(*merged).toArrow()
        n, low, high = forest.bounds(level, np.zeros((0, len(VIEW))))
        node = got["node"].to_numpy()
        n.reshape(-1)[node] = got["n"].to_numpy()
        for k in range(len(VIEW)):
            low[k].reshape(-1)[node], high[k].reshape(-1)[node] = got[lows[k]].to_numpy(), got[highs[k]].to_numpy()
        forest.split(level, n, low, high)
        so_far.unpersist()
    return forest


def quantile(values: DataFrame, share: float) -> float:
    """The value at ``ceil((n - 1) * share)`` of all, in order from 0; infinite if there are none.

    ``values`` has the bit patterns of numbers from 0 up, which are in the order of the numbers, as ``bits``. Each pass counts
    by the next ``RADIX_BITS`` bits under those already known, so that no task sorts the values.
    """
    known, before, rank = None, 0, None
    for shift in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        under = values if known is None else values.where(F.shiftright("bits", shift + RADIX_BITS) == known)
        got = sorted(tuple(r) for r in under.groupBy(F.shiftright("bits", shift).alias("head")).count().collect())
        if not got:
            return np.inf
        if rank is None:
            rank = int(np.ceil((sum(n for _, n in got) - 1) * share))
        for known, n in got:  # noqa: B007
            if rank < before + n:
                break
            before += n
    return float(np.array(known, dtype=np.int64).view(np.float64))


def fit(docs: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> tuple[IsolationForest, float]:
    """The forest over all labelled documents that pass the base rules, and its threshold.

    The threshold is the least score that costs at most ``good_loss`` of all the good ones. The texts are read where they
    lie; only the views of the documents, a few numbers each, meet the labels.
    """
    least = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    with Scratch(docs.sparkSession, "forest") as scratch:
        rows = scratch.stored(passing(docs).join(least, "doc_id").select("quality", *VIEW), "rows")
        forest = grow(rows.select(*VIEW))
        model = docs.sparkSession.sparkContext.broadcast(forest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(model.value.score(_view(batch)).view(np.int64))], ["bits"])

        scores = scratch.stored(rows.where("quality = 1").select(*VIEW).mapInArrow(run, "bits long"), "scores")
        return forest, quantile(scores, 1 - good_loss)


def judge(docs: DataFrame, forest: IsolationForest, threshold: float) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``anomaly`` (the path score) and ``kept`` of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(forest)  # TREES * 2 * 2**DEPTH nodes
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in RULES) + ", base_failed boolean, kept boolean, anomaly double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                s = statistics(piece.column("text"))
                failed, score = base_failed(s), model.value.score(ratios(s))
                columns = [piece.column("doc_id"), *[pa.array(s[k]) for k in RULES], pa.array(failed), pa.array(~failed & (score <= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *RULES, "base_failed", "kept", "anomaly"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, *fit(docs, table(spark, sf_dir, "labels")))
