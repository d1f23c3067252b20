"""Event log sink: JSON lines appended to a folder of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.functions.eventlog import LEVELS, event_json


def append_lines(lines: DataFrame, path: str) -> None:
    """Append a one-column table of JSON lines."""
    lines.write.mode("append").text(path)


def log_event(
    spark: SparkSession, path: str, component: str, event: str, level: str = "INFO", **fields: object
) -> None:
    """Append one event about a finished job."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    columns = {k: v if hasattr(v, "cast") else F.lit(v) for k, v in fields.items()}
    line = event_json(F.lit(component), F.lit(event), level=F.lit(level), fields=columns)
    append_lines(spark.range(1).select(line.alias("value")), path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
