"""The corpus pipeline: five operators in a row over the documents, each written before the next.

Order: quality rules, line dedup, near-dedup, mixing to target weights, encoding. Every stage takes
``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citesift.llm.frames import small_batches, stored
from citesift.llm.linededup import MIN_TEXTS, drop_recurring_lines, drop_repeated_lines
from citesift.llm.mixing import mix
from citesift.llm.neardup import keep_one
from citesift.llm.quality import keep_good
from citesift.llm.queries import coded, domain_labels


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    small_batches(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines leave the texts of all documents but the first; ``n_chars`` stays as given.

    Long lines of two texts wait for near-dedup, which would otherwise meet fragments of near copies.
    """
    return drop_recurring_lines(docs, long_texts=MIN_TEXTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; then a long line stays in one document only."""
    small_batches(spark)
    return drop_repeated_lines(stored(keep_one(docs), "kept-one"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by the rates that meet the target weights."""
    small_batches(spark)
    return mix(docs, domain_labels(spark, sf_dir))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as ids, and whether these decode to the text."""
    small_batches(spark)
    return coded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

# Sketches, a trained classifier and the piece search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
