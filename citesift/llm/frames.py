"""Small helpers for tables whose columns the caller chose."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.session import work_dir


BATCH_RECORDS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch than the default 10,000: rows here are whole texts or lists of ids.

    A worker holds a batch several times over (rows, results, both as Arrow), on every core.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_RECORDS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, also with dots or spaces in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def text_bytes(name: str = "text") -> Column:
    """A text as UTF-8 bytes, NULL as empty."""
    return F.coalesce(column(name).cast("string").cast("binary"), F.lit(b""))


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table below the shared folder and read it back: lineage ends, a lost executor re-reads.

    Every call has a folder of its own, so that no other run can overwrite what this one reads. With ``by``, rows are
    kept apart by that column, and a filter on it reads only its files.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, n_rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows fit ``limit``; else joins shuffle."""
    return F.broadcast(df) if n_rows * row_bytes <= limit else df
