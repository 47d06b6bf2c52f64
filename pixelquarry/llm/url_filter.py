"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

Only DataFrame functions. The model is trained on a small table of labelled URLs: with so few rows the
regression is fitted in its dual form, one coefficient a URL, by gradient steps inside one ``aggregate``; the
weights of the hashed n-grams follow from it and reach the pages as a scalar subquery of ``BUCKETS`` doubles.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged
by the model; a host is lower-cased in A-Z only; of the rules that fit a url the longest wins, and of
equally long ones the one with the longer host; a null or repeated id is an ordinary row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_words
from .tables import table

BUCKETS = 4096
SIZES = (3, 4)
STEPS, RATE, DECAY = 150, 0.5, 0.01

#: (verdict, host, path) of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default training table: ``url`` and ``label`` (1 is block), see ``url_words`` for where it comes from."""
    row = F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in url_words.labelled()]))
    return spark.range(1).select(row.alias("r")).select("r.url", "r.label")


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of host and path, with marks at the ends of each."""

    def cut(text: Column, kind: str, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    ends = [(F.concat(F.lit("^"), t, F.lit("$")), kind) for t, kind in ((host, "h"), (path, "p"))]
    return F.array_distinct(F.concat(*[cut(t, kind, n) for t, kind in ends for n in SIZES]))


def train(labelled: DataFrame) -> DataFrame:
    """One row: ``bias`` and ``weights`` (an array of BUCKETS doubles). The labelled table must be small: it becomes one row."""
    x = labelled.select("url", F.col("label").cast("double").alias("label"), grams(host_of(F.col("url")), path_of(F.col("url"))).alias("x"))
    rows = x.agg(F.array_sort(F.collect_list(F.struct("url", "label", "x"))).alias("rows"))
    kernel = "transform(rows, a -> transform(rows, b -> size(array_intersect(a.x, b.x)) / sqrt(CAST(size(a.x) * size(b.x) AS DOUBLE))))"
    margin = "s.b + aggregate(zip_with(k, s.a, (u, v) -> u * v), 0D, (t, v) -> t + v)"
    errors = f"zip_with(rows, transform(s.k, k -> 1 / (1 + exp(-({margin})))), (r, p) -> r.label - p)"
    step = f"""aggregate(sequence(1, {STEPS}), named_struct('k', {kernel}, 'a', transform(rows, r -> 0D), 'b', 0D), (s, i) ->
        aggregate(array({errors}), s, (old, e) -> named_struct('k', old.k,
            'a', zip_with(old.a, e, (u, v) -> u * {1 - RATE * DECAY}D + {RATE}D * v),
            'b', old.b + {RATE}D * aggregate(e, 0D, (t, v) -> t + v) / greatest(size(e), 1))))"""
    fitted = rows.select("rows", F.expr(step).alias("model"))  # k: the n-gram sets' cosines, worked out once
    each = fitted.select(F.explode(F.arrays_zip(F.col("rows.x").alias("x"), F.col("model.a").alias("a"))).alias("r"))
    each = each.select(F.explode("r.x").alias("bucket"), (F.col("r.a") / F.sqrt(F.size("r.x").cast("double"))).alias("w"))
    buckets = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    dense = buckets.join(each.groupBy("bucket").agg(F.sum("w").alias("w")), "bucket", "left").agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("all"))
    return dense.select(fitted.select("model.b").scalar().alias("bias"), F.col("all.w").alias("weights"))


def judge(pages: DataFrame, model: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``block_score`` of every url; no shuffle of pages."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    rule = verdict = F.lit(None).cast("string")
    for name, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):  # the last to be put around is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, name).otherwise(verdict)
    weights = model.select("weights").scalar()
    found = parts.select("*", rule.alias("rule"), verdict.alias("ruled"), grams(host, path).alias("x"), weights.alias("w"))
    total = F.aggregate("x", F.lit(0.0), lambda t, g: t + F.get(F.col("w"), g))
    score = 1 / (1 + F.exp(-(model.select("bias").scalar() + total / F.sqrt(F.size("x").cast("double")))))
    return found.select("page_id", "host", "path", "rule", "ruled", score.alias("block_score")).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score"
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), train(labelled_urls(spark)), RULES)
