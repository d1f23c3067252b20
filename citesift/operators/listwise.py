"""Listwise boosting: regression trees on the gradients of nDCG.

Every round takes the current order of each query's candidates. Two candidates with different labels pull on each other:
the better one up and the other down, by how wrong their scores are (a logistic weight) times how much nDCG
would change if they swapped places. The sums over a candidate's rivals are its gradient ``g``, those of the slopes its
curvature ``h``. One MLlib regression tree is fitted to ``g / h`` with weights ``h``, so that splits are chosen by
gain and a leaf holds the Newton step ``sum(g) / sum(h)``.

Candidates of one query are few (what retrieval returned), and meet inside one row as an array; no pair ever becomes
a row. Rows are partitioned by query once and stay so: no round shuffles them. All is JVM-side.

The result is an MLlib ensemble of trees, saved and applied like any other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# Added to every curvature: keeps steps finite where scores are far apart, as a penalty on leaf values would.
LEAST_CURVATURE = 1e-3
CUT_LINEAGE = 20


def _gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1


def _discount(place: Column) -> Column:
    """Of places counted from 0."""
    return 1 / F.log2(place + F.lit(2.0))


def with_places(items: Column) -> Column:
    """``label, score, at`` per item: ``at`` is the discount of its place by score, ties in the given order."""

    def placed(x: Column, i: Column) -> Column:
        above = F.filter(items, lambda y, j: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (j < i)))
        return F.struct(x["label"].alias("label"), x["score"].alias("score"), _discount(F.size(above)).alias("at"))

    return F.transform(items, placed)


def ideal_dcg(items: Column) -> Column:
    best = F.sort_array(F.transform(items, lambda x: x["label"]), asc=False)
    return F.aggregate(F.transform(best, lambda y, i: _gain(y) * _discount(i)), F.lit(0.0), lambda a, x: a + x)


def pulls(items: Column, ideal: Column) -> Column:
    """``g, h`` per item of ``with_places`` items: the pull of all its rivals and its curvature."""

    def of(x: Column) -> Column:
        def add(total: Column, y: Column) -> Column:
            up = x["label"] > y["label"]
            ahead = F.when(up, x["score"] - y["score"]).otherwise(y["score"] - x["score"])
            wrong = 1 / (1 + F.exp(ahead))
            swap = F.abs(_gain(x["label"]) - _gain(y["label"])) * F.abs(x["at"] - y["at"]) / ideal
            rivals = x["label"] != y["label"]
            g = F.when(rivals, F.when(up, wrong).otherwise(-wrong) * swap).otherwise(0.0)
            h = F.when(rivals, wrong * (1 - wrong) * swap).otherwise(0.0)
            return F.struct((total["g"] + g).alias("g"), (total["h"] + h).alias("h"))

        return F.aggregate(items, F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h")), add)

    return F.transform(items, of)


class Expressions(NamedTuple):
    """The columns of one round. The same in all rounds, so they are built once."""

    rows: Column
    items: Column
    ideal: Column
    pulls: Column

    @classmethod
    def build(cls) -> Expressions:
        item = F.struct("place", "features", F.col("label").cast("double").alias("label"), "score")
        # Places are unique within a query, so nothing after them is compared.
        rows = F.array_sort(F.collect_list(item))
        return cls(
            rows.alias("rows"),
            with_places(F.col("rows")).alias("items"),
            ideal_dcg(F.col("rows")).alias("ideal"),
            pulls(F.col("items"), F.col("ideal")).alias("pulls"),
        )


def gradients(rows: DataFrame, columns: Expressions | None = None) -> DataFrame:
    """``query_id, place, features, label, g, h`` for ``query_id, place, features, label, score``.

    ``place`` is unique within a query and breaks ties. Queries without a relevant candidate have no rows.
    """
    columns = columns or Expressions.build()
    packed = rows.groupBy("query_id").agg(columns.rows).select("query_id", "rows", columns.items, columns.ideal)
    pulled = packed.where("ideal > 0").select("query_id", "rows", columns.pulls)
    each = pulled.select("query_id", F.explode(F.arrays_zip("rows", "pulls")).alias("x"))
    return each.select("query_id", "x.rows.place", "x.rows.features", "x.rows.label", "x.pulls.g", "x.pulls.h")


def fit_listwise(
    rows: DataFrame, step_size: float, depth: int, min_rows: float, rounds: int, seed: int = 0
) -> GBTRegressionModel:
    """Boost ``rounds`` trees on ``query_id, features`` (a vector) and ``label``."""
    spark = rows.sparkSession
    n_parts = max(1, rows.rdd.getNumPartitions())
    placed = rows.select("query_id", F.monotonically_increasing_id().alias("place"), "features", "label")
    now = placed.withColumn("score", F.lit(0.0)).repartition(n_parts, "query_id")
    now = now.persist(StorageLevel.MEMORY_AND_DISK)
    trees = []
    learner = DecisionTreeRegressor(
        featuresCol="features",
        labelCol="newton",
        weightCol="weight",
        predictionCol="step",
        maxDepth=depth,
        minInstancesPerNode=max(1, round(min_rows)),
        seed=seed,
    )
    weight = F.col("h") + LEAST_CURVATURE
    kept, columns = [now], Expressions.build()
    try:
        for i in range(rounds):
            asked = gradients(now, columns).select("features", (F.col("g") / weight).alias("newton"), weight.alias("weight"))
            kept.append(asked.persist(StorageLevel.MEMORY_AND_DISK))
            if not trees and not asked.take(1):
                raise ValueError("no query has a relevant and another candidate")
            trees.append(learner.fit(asked))
            # Scores of this round are held by now, so what they came from can go.
            for old in kept:
                if old is not now:
                    old.unpersist()
            before, kept = now, [now]
            now = trees[-1].transform(now).withColumn("score", F.col("score") + step_size * F.col("step")).drop("step")
            if (i + 1) % CUT_LINEAGE == 0 and spark.sparkContext.getCheckpointDir():
                now = now.checkpoint().repartition(n_parts, "query_id")
            kept = [before, now.persist(StorageLevel.MEMORY_AND_DISK)]
    finally:
        for old in kept:
            old.unpersist()
    return ensemble(spark, trees, step_size)


def ensemble(spark: SparkSession, trees: list, step_size: float) -> GBTRegressionModel:
    """The trees as one MLlib model: the sum of their steps."""
    gateway = spark.sparkContext._gateway
    kind = gateway.jvm.org.apache.spark.ml.regression
    java_trees = gateway.new_array(kind.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, tree in enumerate(trees):
        java_trees[i], weights[i] = tree._java_obj, step_size
    model = GBTRegressionModel(kind.GBTRegressionModel(f"listwise_{trees[0].uid}", java_trees, weights))
    return model.setFeaturesCol("features")
