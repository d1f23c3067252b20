"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm.frames import stored


def connected(links: DataFrame) -> DataFrame:
    """``v, root``: every end of a link (columns ``a``, ``b``) with the smallest end it can reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    labels travel twice as far in every round. Labels are a written table per round; only the
    number of changed ones comes to the driver.
    """
    near = stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = near.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))
    labels = stored(labels.withColumn("root", F.least("v", "root")), "labels")
    while True:
        others = labels.select(F.col("v").alias("b"), F.col("root").alias("offered"))
        offers = near.join(others, "b").groupBy(F.col("a").alias("v")).agg(F.min("offered").alias("offered"))
        moved = labels.join(offers, "v").select(
            "v", "root", F.least("root", "offered").alias("next")
        )
        jumps = labels.select(F.col("v").alias("next"), F.col("root").alias("jump"))
        moved = stored(
            moved.join(jumps, "next", "left").select(
                "v", "root", F.least("next", F.coalesce("jump", "next")).alias("next")
            ),
            "labels",
        )
        changed = moved.where(F.col("root") != F.col("next")).count()
        labels = moved.select("v", F.col("next").alias("root"))
        if not changed:
            return labels
