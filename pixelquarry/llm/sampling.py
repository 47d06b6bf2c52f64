"""Bounded, repeatable samples of labelled rows, and the fixed hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading bits of a hash by which keys are counted before they are ranked.
SLOT_BITS = 16


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5 (a null id counts as an empty text: held out)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def hash_sample(rows: DataFrame, key: str, size: int, by: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    """The ``size`` keys of least hash for each value of ``by`` (all if there are no more), with the least ``values`` of each key.

    Keys are counted by the leading bits of their hash first, in one partially aggregated pass, so only those under the
    bound, and of one slot beyond it, are ranked. Rows with a null key aren't taken; an empty table gives an empty sample.
    """
    by, values = by or [], values or []
    fields = [F.col(v) for v in values] or [F.lit(0).alias("_none")]
    keys = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.min(F.struct(*fields)).alias("_least"))
    keys = keys.withColumn("_hash", F.xxhash64(key).bitwiseXOR(F.lit(-1 << 63)))  # in the order of the unsigned hash
    keys = keys.withColumn("_slot", F.shiftright("_hash", 64 - SLOT_BITS))
    below = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = keys.groupBy(*by, "_slot").agg(F.count("*").alias("_n")).withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).where(F.col("_below") < size)
    near = keys.join(F.broadcast(slots.drop("_n", "_below")), [*by, "_slot"], "left_semi")  # 2**SLOT_BITS rows at most for each `by`
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_hash", key))).where(F.col("_rank") <= size)
    return ranked.select(*by, key, *[F.col(f"_least.{v}").alias(v) for v in values])
