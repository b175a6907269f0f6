"""The corpus pipeline: quality rules, near-dedup, decontamination, redaction, packing, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm import decontamination, near_dedup, packing, pii, quality
from plantlens.llm.common import modest_batches, table, written
from plantlens.llm.queries import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, four fifths of them shared."""
    modest_batches(spark)
    return near_dedup.deduplicated(docs, threshold=80, shingle=5, rows=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced, n_chars as the new text has."""
    modest_batches(spark)
    return pii.redacted(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in packed sequences."""
    modest_batches(spark)
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("packing", best_fit_packing),
]

#: SQL can't express the learned stages and the packing; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of what the stages keep of documents, packed.

    Null and empty texts go with the quality rules; repeated rows are near duplicates, of which one stays (those without an
    id stay apart); very long texts go through whole; an empty table gives no rows; further columns are carried along until
    the packing, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
