"""A training corpus from raw documents: judged, deduplicated, decontaminated, redacted, mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree_spark.llm import decontamination, mixing, near_dedup, quality, secrets
from doctree_spark.llm.shared import table, words, written


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents likely to have the best grade; the model learns from the rated ones among them.

    A null text is judged as an empty one, rows that repeat an id each for itself; without any rating all stay.
    """
    model = quality.train(docs, quality.grades_of(table(spark, sf_dir, "labels")), quality.GRADES)
    return quality.select_documents(docs, model, quality.GRADES - 1, quality.KEEP_FROM)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Null and blank texts are like nothing and stay; of rows that repeat an id the one with the first text stays.
    """
    return near_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts have none; rows that repeat an id are looked at each for itself.
    """
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; null texts stay null, repeated rows stay."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so ids repeat in what comes out.

    Null and blank texts have no words and are never taken; a null source is one of the sources.
    """
    sized = docs.withColumn("__size", F.size(words(F.col("text"))))
    return mixing.with_copies(mixing.mix(sized, "source", "__size", "doc_id")).drop("__size")


STAGES = [
    ("quality", judge),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", redact),
    ("mixing", mix),
]

#: A fitted model, minhashes and patterns with offsets: no stage list that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
