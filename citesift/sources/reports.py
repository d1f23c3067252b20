"""Report sink: the summary as one JSON object, the per-query rows as JSON lines next to it."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(report: DataFrame, path: str) -> None:
    """Write the one-row report. A skipped part stays visible as an explicit null."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_per_query(per_query: DataFrame, path: str) -> None:
    per_query.write.mode("overwrite").json(path)
