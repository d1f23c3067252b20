"""Reproducible splits: ordered prefix, stratified hold-out, stratified folds.

All numbering goes through ``number_rows``, so a class may hold any share of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesift.operators.numbering import (
    hash_bucket,
    hash_digits,
    hash_order,
    number_rows,
    range_bucketed,
)

VALIDATION_SHARE = 0.3
HOLDOUT_SHARE = 0.3


def prefix_split(queries: DataFrame, share: float = VALIDATION_SHARE) -> DataFrame:
    """Add ``position`` by ``seq`` and ``is_validation``: the first ``max(1, int(n * share))`` rows."""
    n = queries.count()
    n_validation = max(1, int(n * share))
    bucketed = range_bucketed(queries, "seq", n)
    numbered = number_rows(bucketed, [], [F.col("seq")], F.col("_range")).drop("_range")
    return numbered.withColumn("is_validation", F.col("position") <= n_validation)


def holdout_quotas(counts: dict[str, int], share: float = HOLDOUT_SHARE) -> dict[str, int]:
    """Test rows per class: ``ceil(n * share)`` in total, shared out by largest remainder.

    Equal remainders go to the alphabetically first class.
    """
    total = math.ceil(sum(counts.values()) * share)
    exact = {c: total * n / sum(counts.values()) for c, n in counts.items()}
    quotas = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(counts, key=lambda c: (-(exact[c] - quotas[c]), c))
    for c in by_remainder[: total - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def stratified_holdout(
    labelled: DataFrame, label: str, key: str, share: float = HOLDOUT_SHARE
) -> DataFrame:
    """Add ``is_test``: a hash-ordered share of every class.

    The class counts (one row per class) are the only thing the driver sees.
    """
    counts = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}
    quotas = holdout_quotas(counts, share)
    order = hash_order(key)
    bucket = hash_bucket(order, hash_digits(sum(counts.values())))
    numbered = number_rows(labelled, [label], [order, F.col(key)], bucket)
    # One row per class, as literals: no Python worker makes them.
    fields = [T.StructField("_label", labelled.schema[label].dataType), T.StructField("_quota", T.LongType())]
    table = F.array(*[F.struct(F.lit(c).alias("_label"), F.lit(n).alias("_quota")) for c, n in quotas.items()])
    table = table.cast(T.ArrayType(T.StructType(fields)))
    wanted = labelled.sparkSession.range(1).select(F.inline(table))
    return (
        numbered.join(F.broadcast(wanted), F.col(label).eqNullSafe(F.col("_label")))
        .withColumn("is_test", F.col("position") <= F.col("_quota"))
        .drop("_label", "_quota")
    )


def _fold_plan(folds: int) -> list[Column]:
    smallest = F.min("n")
    n_folds = F.greatest(F.lit(2), F.least(F.lit(folds), smallest)).cast("bigint")
    return [smallest.alias("smallest_class"), n_folds.alias("n_folds")]


def fold_count(class_counts: DataFrame, folds: int) -> DataFrame:
    """``smallest_class, n_folds``: at least 2 folds, at most ``folds`` or the smallest class."""
    return class_counts.agg(*_fold_plan(folds))


def class_counts(labelled: DataFrame, label: str) -> DataFrame:
    return labelled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def stratified_folds(labelled: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """Add ``fold`` 0..n-1, dealt out within each class in hash order.

    ``folds`` is lowered to the smallest class, never below 2.
    """
    plan = class_counts(labelled, label).agg(*_fold_plan(folds), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).first()
    order = hash_order(key)
    bucket = hash_bucket(order, hash_digits(plan["n_rows"]))
    numbered = number_rows(labelled, [label], [order, F.col(key)], bucket)
    return numbered.withColumn("fold", ((F.col("position") - 1) % plan["n_folds"]).cast("int")).drop("position")
