"""The corpus pipeline: quality classifier, near-duplicate removal, substring removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``, further ones included, whatever their names; the last returns ``doc_id``, the token ids of each kept text and digests of them.

Defined results, for every stage: an empty table gives an empty one; rows with a null id or a null text are rows like others (no stage joins
a null id to anything); texts are read whole, however long; ties are broken as each function says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquarry.llm import byte_bpe, decontaminate, near_dedup, quality_classifier, substring_dedup
from pixelquarry.llm.sampling import held_out
from pixelquarry.llm.tables import columns_of, fresh, new_folder, quoted, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be bad go. It is fitted on labelled rows of the stage's input.

    A null or empty text is judged by the model's bias; equal texts get equal verdicts; without labels all stay.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    model = quality_classifier.fit(docs.select("doc_id", "text"), labels)
    name = fresh(docs, "score")
    scored = quality_classifier.score(docs, model, keep=docs.columns, name=name)
    return scored.where(F.col(name) >= quality_classifier.CUT).select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id.

    Rows with the same id are one document; of those with the same text as well one stays, the first by its other columns
    as JSON. Null and empty texts and null ids belong to no group.
    """
    groups = near_dedup.near_duplicates(docs.select("doc_id", "text"), shingle=5)
    goes = groups.where(~F.col("kept")).select("doc_id").distinct()
    others = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    number = fresh(docs, "number")
    same = Window.partitionBy("doc_id", F.md5("text")).orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    stays = docs.join(goes, "doc_id", "left_anti").withColumn(number, F.row_number().over(same))
    return stays.where(F.col(number) == 1).select(*columns_of(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that a document with a smaller id has too go; texts without removals, and null ones, stay as they are."""
    return substring_dedup.rewrite(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null id stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (none for a null one), and digests of the ids and of the decoded bytes; a row for each row."""
    return byte_bpe.tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]

#: No SQL expresses a fitted classifier or MinHash; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
