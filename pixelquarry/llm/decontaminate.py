"""Benchmark decontamination by SimHash windows, with DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits. A window is as long as the benchmark item it is
held against. Each gets a 64-bit SimHash of its shingles, weighted by their counts, and is looked up among the items of
its length in a multi-index: ``BLOCKS`` blocks of the fingerprint, each with all flips of up to ``FLIPS`` bits, so that
two fingerprints that differ in at most ``RADIUS`` bits meet in a block. What the index finds is held to the exact weighted similarity of the
shingles: the sum of the lesser counts over the sum of the greater.

A window without a shingle of the item has similarity 0, and one whose first shingle isn't the item's gets no less like it by moving on
a word. So the windows that begin at a shingle of the item, and the last of the document, hold the likest one, and
only these are fingerprinted. At similarity 0.8 fingerprints differ in 10 bits on average and in over ``RADIUS`` bits in some
3 of 100 windows; higher similarities are nearer.

Items are broadcast in blocks of at most ``BLOCK_ROWS`` shingles, one pass over the documents for each
block, so that what is broadcast has a bound. Clean documents are never shuffled.

Defined results: null and empty texts and items match nothing; an item of fewer than five words is one
shingle; a window that would stick out of the document is moved into it; repeated rows count once; a null doc_id is a document, and
a null item_id an item, like others; of equally like windows the first one tried is told; empty tables give an
empty result; other columns aren't read. A very long text costs in proportion to its words, but its words are one array in a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import columns_of, documents, stored, table

SHINGLE = 5
SIMILARITY = 0.8
#: Two of ``BLOCKS * (FLIPS + 1) - 1`` different bits or fewer leave a block with at most ``FLIPS`` of them.
BLOCKS, FLIPS = 4, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
BLOCK_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " ", -1), "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, by place."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    return let(words, of)


def shingle_texts(words: Column, k: Column) -> Column:
    """The runs of ``k`` words themselves."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, k), " "))

    return let(words, of)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def simhash(texts: Column) -> Column:
    """Bit by bit the majority over the hashes of the shingles, each as often as it occurs.

    Four bits are counted at a time, in the 16-bit lanes of a long; longer lists are counted bit by bit.
    """
    one = F.lit(1).cast("long")

    def at(value: Column, k: Column) -> Column:
        return F.call_function("shiftrightunsigned", value, k)

    def lanes(hashes: Column, k: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0).cast("long"), lambda t, h: t + at(h, k).bitwiseAND(F.lit(0x0001000100010001)))
        bit = lambda v, j: F.when(2 * F.shiftrightunsigned(v, 16 * j).bitwiseAND(0xFFFF) > F.size(hashes), F.call_function("shiftleft", one, k + 16 * j)).otherwise(F.lit(0).cast("long"))
        return let(votes, lambda v: bit(v, 0).bitwiseOR(bit(v, 1)).bitwiseOR(bit(v, 2)).bitwiseOR(bit(v, 3)))

    def alone(hashes: Column, j: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0).cast("long"), lambda t, h: t + at(h, j).bitwiseAND(F.lit(1)))
        return F.when(2 * votes > F.size(hashes), F.call_function("shiftleft", one, j)).otherwise(F.lit(0).cast("long"))

    def bits(hashes: Column) -> Column:
        def over(count: int, of: Callable[[Column, Column], Column]) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.lit(0).cast("long"), lambda t, k: t.bitwiseOR(of(hashes, k)))

        return F.when(F.size(hashes) < 1 << 16, over(16, lanes)).otherwise(over(64, alone))

    return let(F.transform(texts, lambda t: F.xxhash64(t)), bits)


def blocks_of(fingerprint: Column) -> Column:
    """The blocks of a fingerprint, each with its number."""
    width = 64 // BLOCKS
    return F.array(*[F.shiftrightunsigned(fingerprint, i * width).bitwiseAND((1 << width) - 1) + (i << width) for i in range(BLOCKS)])


def near_blocks(fingerprint: Column) -> Column:
    """The blocks of a fingerprint with every flip of up to ``FLIPS`` of their bits."""
    flips = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << 64 // BLOCKS) - 1)), lambda m: F.bit_count(m) <= FLIPS)
    return let(flips, lambda masks: F.flatten(F.transform(blocks_of(fingerprint), lambda b: F.transform(masks, lambda m: b.bitwiseXOR(m)))))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Of two lists of shingles, as multisets."""

    def of(x: Column, y: Column) -> Column:
        count = lambda z, s: F.size(z) - F.size(F.array_remove(z, s))
        plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
        common = F.array_intersect(x, y)
        shared = F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda t, s: t + F.least(count(x, s), count(y, s))))
        return let(shared, lambda n: n / (F.size(x) + F.size(y) - n))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item`` (a key of id and words), ``item_id``, its words, ``length``, shingle length ``k``, shingle texts and fingerprint; without empty and repeated items."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    items = items.withColumns({"item": F.xxhash64("item_id", F.col("item_id").isNull(), "item_words"), "length": F.size("item_words"), "k": F.least(F.lit(SHINGLE), F.size("item_words"))})
    items = items.withColumn("item_shingles", shingle_texts(F.col("item_words"), F.col("k")))
    return items.withColumn("item_print", simhash(F.col("item_shingles")))


def _windows(docs: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Windows of ``docs`` as long as an item, where one of the item's shingles of ``k`` words begins, or at the document's end."""
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    worded = worded.select("doc_id", "words", F.posexplode(shingles(F.col("words"), k)).alias("place", "hash"))
    found = worded.join(F.broadcast(anchors), "hash")  # BLOCK_ROWS rows at most
    start = F.greatest(F.lit(0), F.least(F.col("place"), F.size("words") - F.col("length")))
    return found.select("doc_id", "length", start.alias("start"), F.slice(F.col("words"), start + 1, F.col("length")).alias("window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity`` and ``start`` (word number) of the likest window, for pairs at or above ``similarity``."""
    items = stored(items_of(benchmark), "benchmark-items")
    hashes = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("item_words"), k)) for k in range(1, SHINGLE + 1)])
    anchors = stored(items.select("k", "length", F.explode(hashes).alias("hash")).distinct(), "benchmark-anchors")
    sizes = anchors.groupBy("k").count().collect()  # at most SHINGLE rows
    parts = []
    for k, rows in sorted((r["k"], r["count"]) for r in sizes):
        passes = -(-rows * 5 // (4 * block_rows)) if rows > block_rows else 1
        for i in range(passes):
            block = anchors.where((F.col("k") == k) & (F.pmod(F.xxhash64("hash"), F.lit(passes)) == i)).drop("k")
            parts.append(_windows(docs, block, k))
    if not parts:
        kinds = {f.name: f.dataType.simpleString() for f in (docs.schema["doc_id"], benchmark.schema["item_id"])}
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, similarity double, start int")
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    # A document holds few windows of an item's length, so this is a small part of the texts.
    windows = windows.distinct().repartition("doc_id", "start", "length")
    texts = shingle_texts(F.col("window"), F.least(F.lit(SHINGLE), F.col("length")))
    printed = stored(windows.select("doc_id", "start", "length", "window", simhash(texts).alias("print")), "benchmark-windows")

    index = items.select("item", "length", F.col("item_print"), F.explode(near_blocks(F.col("item_print"))).alias("block"))
    asked = printed.select("doc_id", "start", "length", "print", F.explode(blocks_of(F.col("print"))).alias("block"))
    near = asked.join(index, ["length", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    pairs = near.select("doc_id", "start", "length", "item").distinct()
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("doc_id", "start", "length")]
    held = pairs.alias("p").join(printed.alias("w"), same).select("w.doc_id", "w.start", "w.window", "p.item").join(items.select("item", "item_id", "k", "item_shingles"), "item")
    held = held.withColumn("similarity", weighted_similarity(shingle_texts(F.col("window"), F.col("k")), F.col("item_shingles")))
    best = held.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose text holds a benchmark item; rows with a null id stay."""
    hits = contaminated(docs.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*columns_of(docs))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
