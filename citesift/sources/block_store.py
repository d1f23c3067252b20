"""The chunk index kept in blocks: one partition per block, and a summary of each next to it."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesift.operators.blocks import (
    BLOCK_ROWS,
    FILE_ROWS,
    MAX_BLOCKS,
    SUMMARY,
    BlockedIndex,
    fit_centres,
    nearest,
    placed_rows,
    sample_vectors,
    summarised,
)
from citesift.operators.contracts import check_index_facts
from citesift.session import work_dir, write_and_read
from citesift.sources.index_store import INDEX_SCHEMA

MEASURES = ["distance", "cosine", "norm"]
ROWS_SCHEMA = T.StructType(
    [*INDEX_SCHEMA.fields, *[T.StructField(c, T.DoubleType()) for c in MEASURES], T.StructField("block", T.IntegerType())]
)


def write_blocked_index(
    index: DataFrame, path: str, block_rows: int = BLOCK_ROWS, stored: bool = False
) -> BlockedIndex:
    """Save an index in about one block per ``block_rows`` chunks, ``MAX_BLOCKS`` at most, and reopen it.

    The index is computed once and written, unless it is ``stored``, a table that only needs to be read. Centres
    are fitted to a bounded sample, and every chunk goes to the nearest, once. That is the one shuffle of the index.
    A block that by the sample holds more than ``FILE_ROWS`` chunks, as of copies, is written by several tasks.
    """
    spark = index.sparkSession
    columns = [c if c in index.columns else F.lit(None).cast("string").alias(c) for c in INDEX_SCHEMA.names]
    index = index.select(columns)
    if not stored:
        index = write_and_read(index, f"{work_dir(spark)}/unblocked/{uuid.uuid4().hex}")
    n = index.count()
    sample = sample_vectors(index, n)
    centres = fit_centres(sample, min(MAX_BLOCKS, max(1, -(-n // block_rows))))
    held = np.bincount(nearest(sample, centres), minlength=len(centres)) if len(sample) else np.ones(1)
    # At most ``MAX_BLOCKS`` numbers.
    parts = np.ceil(np.maximum(1, held * n / max(1, held.sum()) / FILE_ROWS)).astype(int).tolist()
    part = F.pmod(F.xxhash64("chunk_id"), F.element_at(F.lit(parts), F.col("block") + 1))
    placed = placed_rows(index, centres).repartition(sum(parts), "block", part)
    placed.select(ROWS_SCHEMA.names).write.mode("overwrite").partitionBy("block").parquet(path)
    rows = spark.read.schema(ROWS_SCHEMA).parquet(path)
    # Written last: it marks the index as complete.
    summarised(rows, centres).coalesce(1).write.mode("overwrite").parquet(f"{path}.blocks")
    return read_blocked_index(spark, path)


def read_blocked_index(spark: SparkSession, path: str) -> BlockedIndex:
    """Open a saved index in blocks. Its row count must be that of the summary, with one vector size."""
    try:
        summary = spark.read.schema(SUMMARY).parquet(f"{path}.blocks")
        rows = spark.read.schema(ROWS_SCHEMA).parquet(path)
    except AnalysisException as e:
        raise ValueError(f"{path} is no complete index in blocks: write it again") from e
    dim = F.size("centre").cast("long")
    n = F.coalesce(F.sum("n_rows"), F.lit(0))
    facts = summary.agg(n.alias("n_chunks"), n.alias("n_vectors"), F.min(dim).alias("min_dim"), F.max(dim).alias("max_dim"))
    check_index_facts(facts.first().asDict(), rows.count())
    return BlockedIndex(rows, summary)
