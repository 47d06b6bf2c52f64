"""Quality classifier: naive Bayes features under a linear support vector machine.

Each document is the set of its hashed n-grams: words, pairs of words, pairs of
word shapes (lengths, and whether the two are equal), byte triples and bytes. A set's
indicators are scaled by the log ratio of the n-gram's rates in the two classes, and a hinge-loss linear
model is fitted to them by dual coordinate descent. The margin becomes a score by a logistic curve fitted on
the training rows.

Defined results: a null or empty text has no n-grams and gets the model's bias; with no labelled row, or
rows of one class only, every score is that class's (1 without labels); repeated rows give repeated rows, and a labelled id
counts once, with the least of its labels; equal hashes of n-grams are one feature; an empty table gives an empty one; other columns aren't read, or
come along unchanged if named in ``keep``; a very long text is one set of hashed n-grams, some 40 bytes a byte while it is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import hash_sample, held_out
from .tables import quoted, table
from .textbytes import Words, byte_view, lower_ascii, mix64, pieces, window_hashes

#: Bound of the labelled sample on the driver, and width of the hashed feature space.
SAMPLE_ROWS = 4096
BITS = 18
PASSES = 12
PENALTY = 0.1
CUT = 0.3
#: Bytes of text whose n-grams are worked out at a time, at some 200 bytes of memory each.
PIECE_BYTES = 500_000


def ngrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, as one array, and each text's offsets into it."""
    raw, offsets = byte_view(text)
    raw = lower_ascii(raw)
    words = Words(raw, offsets)
    word, pair = words.hashes(), words.windows(2)
    triple = np.flatnonzero(words.raw[2:] >= 0) if len(raw) > 2 else np.zeros(0, np.int64)
    byte_doc = np.repeat(np.arange(len(text)), np.diff(offsets))
    triple = triple[byte_doc[triple] == byte_doc[triple + 2]] if len(triple) else triple
    wide = raw.astype(np.uint64)
    code = wide[triple] | wide[triple + 1] << np.uint64(8) | wide[triple + 2] << np.uint64(16) | np.uint64(1 << 24)
    mask = np.uint64((1 << BITS) - 1)
    same = (word[pair] == word[pair + 1]).astype(np.uint64)
    size = np.minimum(words.end - words.start, 31).astype(np.uint64)
    shape = size[pair] | size[pair + 1] << np.uint64(5) | same << np.uint64(10) | np.uint64(1 << 26)
    parts = [(words.doc[pair], mix64(shape)), (words.doc[pair], mix64(same | np.uint64(1 << 27))), (words.doc, word), (words.doc[pair], window_hashes(word, pair, 2)), (byte_doc[triple], mix64(code)), (byte_doc, mix64(wide | np.uint64(1 << 25)))]
    key = np.concatenate([d.astype(np.uint64) << np.uint64(BITS) | h >> np.uint64(64 - BITS) & mask for d, h in parts])
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    doc = (key >> np.uint64(BITS)).astype(np.int64)
    return (key & mask).astype(np.int32), np.searchsorted(doc, np.arange(len(text) + 1))


class SupportVectors:
    """Weights over hashed n-grams, and the curve from margin to score."""

    def __init__(self, rows: list[np.ndarray], good: np.ndarray, passes: int = PASSES, penalty: float = PENALTY, seed: int = 11):
        width = 1 << BITS
        self.weights, self.bias, self.slope, self.shift = np.zeros(width), 0.0, 0.0, 40.0
        if not len(rows) or good.all() or not good.any():
            self.shift = -40.0 if len(rows) and not good.any() else 40.0
            return
        counts = np.ones((2, width))
        for row, label in zip(rows, good.astype(int), strict=True):
            counts[label, row] += 1
        rate = counts / counts.sum(axis=1, keepdims=True)
        ratio = np.log(rate[1] / rate[0])
        scaled = []
        for row in rows:
            x = ratio[row]
            scaled.append(x / max(float(np.sqrt(x @ x + 1)), 1e-9))
        sign = np.where(good, 1.0, -1.0)
        # The rarer class weighs as much in all as the other.
        upper = penalty * len(rows) / 2 / np.where(good, good.sum(), (~good).sum())
        alpha, w, bias = np.zeros(len(rows)), np.zeros(width), 0.0
        square = np.array([x @ x + 1 for x in scaled])
        rng = np.random.Generator(np.random.PCG64(seed))
        for _ in range(passes):
            for i in rng.permutation(len(rows)):
                margin = sign[i] * (w[rows[i]] @ scaled[i] + bias) - 1
                new = min(max(alpha[i] - margin / square[i], 0.0), upper[i])
                if new != alpha[i]:
                    step = (new - alpha[i]) * sign[i]
                    w[rows[i]] += step * scaled[i]
                    bias += step
                    alpha[i] = new
        self.weights, self.bias, self._ratio = w, bias, ratio
        margins = np.array([w[r] @ x + bias for r, x in zip(rows, scaled, strict=True)])
        self._curve(margins, good)

    def _curve(self, margins: np.ndarray, good: np.ndarray) -> None:
        """Logistic regression of the label on the margin, by Newton steps, with smoothed targets."""
        target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
        weight = np.full(len(good), 1 / len(good))
        design, theta = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            slope = design.T @ (weight * (p - target)) + 1e-4 * theta
            bend = design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-4 * np.eye(2)
            theta = theta - np.linalg.solve(bend, slope)
        self.slope, self.shift = map(float, theta)

    def scores(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.slope:
            margin = np.zeros(len(offsets) - 1)
        else:
            ratio, w = self._ratio[features], self.weights[features]

            def total(x: np.ndarray) -> np.ndarray:
                sums = np.concatenate(([0.0], np.cumsum(x)))
                return sums[offsets[1:]] - sums[offsets[:-1]]

            margin = total(ratio * w) / np.sqrt(total(ratio * ratio) + 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_ROWS) -> SupportVectors:
    """A model from the texts of at most ``size`` labelled rows; their n-gram sets go to the driver."""
    chosen = hash_sample(labels.where(F.col("quality").isNotNull()), "doc_id", size, values=["quality"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                found, at = ngrams(piece.column("text"))
                grams = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), grams], ["doc_id", "quality", "grams"])

    rows = (
        docs.join(F.broadcast(chosen), "doc_id")  # at most `size` rows
        .select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
        .mapInArrow(run, "doc_id long, quality int, grams array<int>")
        .toArrow()
        .to_pandas()
        .drop_duplicates("doc_id")
        .sort_values("doc_id")
    )
    return SupportVectors([np.asarray(x) for x in rows["grams"]], rows["quality"].to_numpy() == 1)


def score(docs: DataFrame, model: SupportVectors, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (``doc_id`` unless told) with the score, called ``name``, of every whole text, where it is read."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights
    sent = [*keep, *(["text"] if "text" not in keep else [])]
    numbered = docs.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(sent)])
    fields = numbered.select(*[f"k{i}" for i in range(len(keep))]).schema.add("score", "double")
    text = f"k{sent.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, limit=PIECE_BYTES):
                found = shared.value.scores(*ngrams(piece.column(text)))
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(keep))], pa.array(found)], [f.name for f in fields])

    out = numbered.mapInArrow(run, fields)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(name))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = score(docs, fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
