"""Evaluation of ranking and of the whole run, and the report that keeps the numbers readable."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesift.operators.blocks import BlockedIndex, topk
from citesift.operators.features import PairScorer, label_candidates, rank_features, with_query_tokens
from citesift.operators.metrics import compare_orders, ranking_summary
from citesift.operators.rerank import Ranker, rerank
from citesift.operators.topk import attach_passages

GROUNDING = T.StructType(
    [
        T.StructField("mean_valid_citation_fraction", T.DoubleType()),
        T.StructField("answers_with_citation", T.DoubleType()),
        T.StructField("n_queries", T.LongType()),
    ]
)


@dataclass(frozen=True)
class RunConfig:
    """What a report must say about the run, or its numbers mean nothing."""

    embed_model: str
    llm_model: str
    retrieve_top_k: int
    rerank_top_k: int
    eval_train_path: str
    eval_path: str
    intents_path: str


def candidates(
    queries: DataFrame,
    index: DataFrame | BlockedIndex,
    k: int,
    scorer: PairScorer,
    pilot_fraction: float | None = None,
) -> DataFrame:
    """Retrieved, featurised candidates of every query. ``queries``: ``query_id, query, embedding``.

    An index in blocks is searched and read block by block, others are scanned. Queries without hits have no rows. Query ids must be unique, as hits are kept by them.
    """
    n, n_ids = queries.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    if n != n_ids:
        raise ValueError(f"{n} queries have {n_ids} different ids")
    vectors = queries.select("query_id", "embedding")
    found = topk(vectors, index, k, pilot_fraction)
    rows = index.rows if isinstance(index, BlockedIndex) else index
    hits = attach_passages(found, rows, max_hits=n * k)
    # The query's text rejoins the hits; its vector stays behind.
    asked = scorer.prepare(with_query_tokens(queries.drop("embedding")))
    return rank_features(hits.join(asked, "query_id"), scorer)


def evaluate_ranking(features: DataFrame, relevance: DataFrame, ranker: Ranker, k: int) -> DataFrame:
    """Per query: both orders' metrics and the delta. All candidates are re-ordered, none is cut."""
    labelled = label_candidates(rerank(features, ranker), relevance)
    return compare_orders(labelled, relevance, k)


def build_report(
    per_query: DataFrame,
    routing: DataFrame,
    grounding: DataFrame | None,
    config: RunConfig,
    per_query_path: str | None = None,
) -> DataFrame:
    """One nested row: time, config, and the metrics of ranking, routing and grounding.

    A skipped grounding run is a NULL struct. The per-query rows are a table of their own, however
    many they are; the report names its path.
    """
    ranking = ranking_summary(per_query)
    ranking = ranking.withColumn("per_query_path", F.lit(per_query_path).cast("string"))
    parts = [
        ranking.select(F.struct(*ranking.columns).alias("reranker")),
        routing.select(F.struct(*routing.columns).alias("intent")),
    ]
    if grounding is not None:
        parts.append(grounding.select(F.struct(*grounding.columns).alias("grounding")))
    report = _one_row(*parts)
    if grounding is None:
        report = report.withColumn("grounding", F.lit(None).cast(GROUNDING))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in vars(config).items()])
    return report.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("generated_at"),
        settings.alias("config"),
        "reranker",
        "intent",
        "grounding",
    )


def _one_row(*parts: DataFrame) -> DataFrame:
    """Merge one-row tables with different columns into one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
