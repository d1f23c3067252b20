"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; row ``r`` of ``n`` stands at the
fraction ``(2r - 1) / 2n``. Sorted by that fraction, the sources run through the whole table at
constant speed, so any cut into equal pieces gives every shard the mixture of the table.

Both numberings work on buckets of bounded size: the first on leading digits of the hash, so that a
source with a third of all rows is many tasks, the second on slices of the fraction, which are
equally full whatever the sources' sizes. Only bucket counts are summed in one place, and one row
has to cross two shuffles, with the columns asked for and no others.

Law ``rows``: shard sizes are at most one row apart, slots run from 0 without a gap.

Defined cases: NULL sources form a source; repeated rows each get a place; rows with equal hash are
ordered by the tie columns, and rows equal in all of them are interchangeable; an empty table gives
an empty result; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.llm.frames import column, fresh, stored

N_SHARDS = 16
SEED = "interleave-1"
BUCKET_ROWS = 50_000
MIN_SLICES = 64


def seeded_order(key: str, seed: str = SEED) -> Column:
    """First half of the md5 of seed and key; NULL keys hash as an empty string."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(column(key).cast("string"), F.lit("")))
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def interleave(
    rows: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    ties: tuple[str, ...] = (),
    n_shards: int = N_SHARDS,
    seed: str = SEED,
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0).

    Every column of ``rows`` is carried along: select the wanted ones first. A column named ``shard``
    or ``slot`` is replaced.
    """
    rows = rows.drop("shard", "slot")
    n_rows = rows.count()
    digits = max(1, math.ceil(math.log(max(1, n_rows / BUCKET_ROWS), 16)))
    order, part, place, share, piece = (
        fresh(rows, c) for c in ("order", "part", "place", "share", "piece")
    )

    def parted(columns: list[Column]) -> DataFrame:
        hashed = rows.select(*columns, seeded_order(key, seed).alias(order))
        return hashed.withColumn(part, F.substring(order, 1, digits))

    total, before, host, at = (fresh(rows, c) for c in ("total", "before", "host", "at"))
    per_source = Window.partitionBy(host)
    offsets = (
        parted([column(source).alias(host)])
        .groupBy(host, F.col(part).alias(at))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            host,
            at,
            F.sum("n").over(per_source).alias(total),
            (F.sum("n").over(per_source.orderBy(at)) - F.col("n")).alias(before),
        )
    )
    tied = [F.col(order), column(key), *[column(t) for t in ties]]
    inside = F.row_number().over(Window.partitionBy(column(source), F.col(part)).orderBy(*tied))
    ranked = (
        parted([column(c) for c in rows.columns])
        .withColumn(place, inside)
        .join(offsets, column(source).eqNullSafe(F.col(host)) & (F.col(part) == F.col(at)))
        .withColumn(share, (2 * (F.col(place) + F.col(before)) - 1) / (2 * F.col(total)))
        .drop(part, place, host, at, total, before)
    )

    slices = max(MIN_SLICES, -(-n_rows // BUCKET_ROWS))
    ranked = stored(ranked.withColumn(piece, F.floor(F.col(share) * slices)), "fractions")
    starts = ranked.groupBy(F.col(piece).alias(at)).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(
        at, (F.sum("n").over(Window.orderBy(at)) - F.col("n")).alias(before)
    )  # one row per slice
    within = F.row_number().over(Window.partitionBy(piece).orderBy(F.col(share), *tied))
    position = F.col(place) + F.col(before) - 1
    shard = F.floor(position * n_shards / F.lit(n_rows))
    first = F.floor((F.col("shard") * n_rows + (n_shards - 1)) / n_shards)
    return (
        ranked.withColumn(place, within)
        .join(starts, F.col(piece) == F.col(at))
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (position - first).cast("bigint"))
        .select(*[column(c) for c in rows.columns], "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 200_000) -> None:
    """One folder per shard; file ``n`` of a shard holds its slots from ``n * rows_per_file`` on, in order."""
    piece = fresh(sharded, "piece")
    (
        sharded.withColumn(piece, F.floor(F.col("slot") / rows_per_file))
        .repartition("shard", piece)
        .sortWithinPartitions("shard", "slot")
        .drop(piece)
        .write.partitionBy("shard")
        .parquet(path)
    )
