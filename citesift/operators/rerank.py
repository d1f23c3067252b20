"""Re-ordering candidates by a learned score; ties keep retrieval order.

A ranker is any object with ``score(features) -> DataFrame`` that adds ``rerank_score``.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesift.operators.features import FEATURES

LINEAR_WEIGHTS = (0.5, 0.3, 0.2)


class Ranker(Protocol):
    def score(self, features: DataFrame) -> DataFrame: ...


class LinearRanker:
    """Frozen weights over the three features: an order that needs no training."""

    def __init__(self, weights: tuple[float, float, float] = LINEAR_WEIGHTS):
        self.weights = weights

    def score(self, features: DataFrame) -> DataFrame:
        total = sum(F.lit(w) * F.col(f) for w, f in zip(self.weights, FEATURES, strict=True))
        return features.withColumn("rerank_score", total.cast("float").cast("double"))


class ModelRanker:
    """A trained pipeline: the score is its margin (classifier) or its prediction (regressor)."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def score(self, features: DataFrame) -> DataFrame:
        scored = self.model.transform(features)
        margin = "rawPrediction" in scored.columns
        score = vector_to_array("rawPrediction")[1] if margin else F.col("prediction")
        return scored.withColumn("rerank_score", score.cast("float").cast("double")).select(
            *features.columns, "rerank_score"
        )


def rerank(features: DataFrame, ranker: Ranker, top_k: int | None = None) -> DataFrame:
    """Add ``rerank_score, rerank_rank``; keep ``top_k`` per query, or all for evaluation."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    ranked = ranker.score(features).withColumn("rerank_rank", F.row_number().over(order))
    return ranked if top_k is None else ranked.where(F.col("rerank_rank") <= top_k)


def passage_lists(ranked: DataFrame, rank: str = "rerank_rank") -> DataFrame:
    """``query_id, passages``: the ranked rows of each query as an ordered array.

    For cut rankings only: an array holds at most ``top_k`` passages.
    """
    entry = F.struct(F.col(rank).alias("rank"), "chunk_id", "doc_id", "source", "text")
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("passages"))
