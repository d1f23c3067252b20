"""Rollup of served events per time window and intent: volume, refusal rate, latency percentiles.

Streams keep counts per (window, intent, refused, latency) and never all latencies of a window
in one state row, so a busy window spreads over the cluster. Percentiles are read off the counts.
Two forms: closed windows only, from Spark's own state, or all windows at any time, from the added counts
of the batches, with late rows told apart.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citesift.operators.latency import summarize_counts

WINDOW = "1 day"
LATENESS = "1 hour"
COUNT_SCHEMA = "window_start timestamp, intent string, refused boolean, latency_ms double, n long"


def latency_counts(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """``window_start, intent, refused, latency_ms, n`` of ``ts TIMESTAMP, intent, refused, latency_ms``.

    Works on streams (with a watermark) and tables alike.
    """
    return (
        events.groupBy(F.window("ts", window).alias("w"), "intent", "refused", "latency_ms")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "intent", "refused", "latency_ms", "n")
    )


def stream_latency_counts(
    events: DataFrame, path: str, checkpoint: str, window: str = WINDOW, lateness: str = LATENESS
) -> StreamingQuery:
    """Append the counts of closed windows. Rows later than ``lateness`` are dropped."""
    return (
        latency_counts(events.withWatermark("ts", lateness), window)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_window_counts(
    events: DataFrame, path: str, checkpoint: str, window: str = WINDOW, lateness: str = LATENESS
) -> StreamingQuery:
    """Add the counts of every batch to the table below ``path``: open windows too, and no row is dropped.

    Counts of a window add up, so the table itself is the state: a batch writes one folder of its own
    counts, and a batch that is run again after a failure overwrites its folder. A row is late if its window
    had ended ``lateness`` before the newest row of the batches before; late rows are counted apart
    (``late``). Rows without a time are in no window. A table belongs to one checkpoint.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest(spark, path, batch_id)
        late = F.lit(False)
        if newest is not None:
            late = F.col("w.end") <= F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        counts = (
            batch.groupBy(F.window("ts", window).alias("w"), "intent", "refused", "latency_ms")
            .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))
            .select(F.col("w.start").alias("window_start"), "intent", "refused", "latency_ms", "n", "newest", late.alias("late"))
        )
        target = f"{path}/counts/batch={batch_id}"
        counts.write.mode("overwrite").parquet(target)
        seen = spark.read.parquet(target).agg(F.max("newest").alias("newest"))
        seen.coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_window_counts(spark: SparkSession, path: str, late: bool | None = None) -> DataFrame:
    """The counts so far, one row per key: of all rows, or of the late or punctual ones only."""
    counts = spark.read.schema(f"{COUNT_SCHEMA}, late boolean").parquet(f"{path}/counts")
    if late is not None:
        counts = counts.where(F.col("late") == late)
    keys = ["window_start", "intent", "refused", "latency_ms"]
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def rollup(counts: DataFrame) -> DataFrame:
    """``window_start, intent, n, refusal_rate, p50, p95, mean`` from the counts.

    ``n`` counts all events; those without a latency are left out of the other numbers.
    """
    groups = ["window_start", "intent"]
    values = counts.groupBy(*groups, F.col("latency_ms").alias("value")).agg(F.sum("n").alias("n"))
    volume = counts.groupBy(*[F.col(g).alias(f"of_{g}") for g in groups]).agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(F.col("refused"), F.col("n")).otherwise(0)) / F.sum("n")).alias("refusal_rate"),
    )
    found = summarize_counts(values, groups, (0.5, 0.95)).drop("n")
    same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups]
    return found.join(volume, same[0] & same[1]).select(
        *groups, "n", "p50", "p95", "mean", "refusal_rate"
    )


def _newest(spark: SparkSession, path: str, batch_id: int):
    """The time of the newest row before this batch; one row per batch is read."""
    try:
        seen = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/newest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return seen.where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
