"""Bounded samples of groups of any size: the rows of each group that come first in a hash order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows below the first bound, as a multiple of the rows wanted, and some more for small numbers.
MARGIN, SLACK = 2, 64


def first_rows(rows: DataFrame, group: str, order: Column, tie: str, wanted: dict, sizes: dict) -> DataFrame:
    """The ``wanted[g]`` rows of each group ``g`` with the smallest ``(order, tie)``.

    ``rows`` is a stored table, ``order`` a hash of 64 bits, and ``sizes`` the counted rows of the groups; groups
    missing there are left out. Only rows below a bound of the hash reach the window, about ``MARGIN`` times as many as
    wanted, so a group of any size is ranked in one small task. The bounds are raised until enough rows
    lie below them; the result never depends on them. Groups are few: they stand in the plan one by one.
    """
    share = {g: min(1.0, (MARGIN * wanted[g] + SLACK) / n) for g, n in sizes.items() if n}
    if not share:
        return rows.where(F.lit(False))
    while True:
        inside = reduce(
            lambda a, b: a | b,
            [(F.col(group) == F.lit(g)) & (F.lit(True) if s >= 1 else order < F.lit(_bound(s))) for g, s in share.items()],
        )
        below = rows.where(inside)
        found = {r[group]: r["count"] for r in below.groupBy(group).count().collect()}
        short = [g for g, s in share.items() if s < 1 and found.get(g, 0) < wanted[g]]
        if not short:
            break
        share |= {g: min(1.0, 2 * share[g]) for g in short}
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order, tie))
    limit = reduce(lambda chain, g: chain.when(F.col(group) == F.lit(g), wanted[g]), share, F.when(F.lit(False), 0))
    return below.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def _bound(share: float) -> int:
    return -(1 << 63) + int(share * (1 << 64))
