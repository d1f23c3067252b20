"""Labelled sets kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELEVANCE = T.StructType(
    [T.StructField("query", T.StringType()), T.StructField("relevant_docs", T.ArrayType(T.StringType()))]
)
INTENT = T.StructType([T.StructField("query", T.StringType()), T.StructField("intent", T.StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per non-blank line; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def relevance_pairs(labelled: DataFrame) -> DataFrame:
    """Flat ``query_id, doc_id`` pairs from ``query_id, relevant_docs``."""
    return labelled.select("query_id", F.explode("relevant_docs").alias("doc_id")).distinct()


def with_file_order(labelled: DataFrame) -> DataFrame:
    """Add ``query_id`` and ``seq``, the line order within a file.

    ``monotonically_increasing_id`` follows the split order of one uncompressed file, which is
    enough for an order; it is not a dense count.
    """
    return labelled.withColumn("seq", F.monotonically_increasing_id()).withColumn(
        "query_id", F.col("seq").cast("string")
    )
