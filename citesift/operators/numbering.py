"""Row numbers within groups of any size.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sorts each group in one task, which fails when
one group holds a third of a very large table. Here every group is cut into ordered buckets; rows
are numbered within their bucket and shifted by the size of the buckets before it. The numbers are
the same; only the bucket counts, a small table, are summed per group.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that one task numbers, about.
BUCKET_ROWS = 250_000
HASH_BUCKET_DIGITS = 3
SEQUENCE_SPAN = 1_000_000


def hash_order(*columns: str) -> Column:
    """A reproducible shuffling order: the md5 of the given columns."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"))


def hash_bucket(order: Column, digits: int = HASH_BUCKET_DIGITS) -> Column:
    """Leading hex digits: an ordered bucket of a hash order, ``16 ** digits`` of nearly equal size."""
    return F.substring(order, 1, digits)


def hash_digits(n_rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """As many hex digits as keep the buckets of ``n_rows`` rows below ``bucket_rows``, about."""
    digits = 1
    while 16**digits * bucket_rows < n_rows:
        digits += 1
    return digits


def range_bucketed(
    df: DataFrame, column: str, n_rows: int, name: str = "_range", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add ``name``: an ordered bucket of a number, of about ``bucket_rows`` rows each whatever its gaps.

    The bounds are approximate quantiles, one per bucket. Rows without a number go, as they have no place.
    """
    df = df.where(F.col(column).isNotNull())
    n = max(1, math.ceil(n_rows / bucket_rows))
    bounds = sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    if not bounds:
        return df.withColumn(name, F.lit(0.0))
    splits = [-math.inf, *bounds, math.inf]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name).transform(df)


def sequence_bucket(seq: Column, span: int = SEQUENCE_SPAN) -> Column:
    """Ordered bucket of a unique whole number: at most ``span`` rows each."""
    return F.floor(seq / F.lit(span))


def number_rows(
    df: DataFrame, groups: list[str], order: list[Column], bucket: Column, name: str = "position"
) -> DataFrame:
    """Add ``name``: 1, 2, .. within ``groups`` by ``order``.

    ``bucket`` must not decrease along ``order`` and should split groups into bounded pieces.
    """
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = (
        Window.partitionBy(*groups)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
    )
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(*order))
    helpers = ["_bucket", "_b", "_offset", "_inside", *[f"_g{i}" for i in range(len(groups))]]
    return (
        keyed.withColumn("_inside", inside)
        .join(offsets, same)
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("bigint"))
        .drop(*helpers)
    )
