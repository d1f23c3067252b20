"""Evaluate: ranking on held-out queries, routing on a hold-out, grounding if there is a generator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.operators.embedding import Encoder
from citesift.operators.evaluation import RunConfig, build_report, evaluate_ranking
from citesift.operators.features import Bm25Scorer, PairScorer
from citesift.operators.generation import Generator
from citesift.operators.grounding import answer_and_score, grounding_summary
from citesift.operators.metrics import ranking_summary
from citesift.operators.rerank import ModelRanker, rerank
from citesift.operators.routing import ROUTER_CONFIG_SCHEMA, RouterConfig, evaluate_router
from citesift.plans.ask import RERANK_TOP_K, RETRIEVE_TOP_K
from citesift.plans.ingest import saved_stats
from citesift.plans.train import Paths, labelled_candidates
from citesift.session import work_dir, write_and_read
from citesift.sources.encoders import index_encoder
from citesift.sources.eventlog import log_event
from citesift.sources.index_store import read_index
from citesift.sources.labels import INTENT, read_jsonl, with_file_order
from citesift.sources.models import load_model, load_setting
from citesift.sources.reports import write_per_query, write_report


def evaluate_models(
    spark: SparkSession,
    paths: Paths,
    encoder: Encoder,
    router_config: RouterConfig | None = None,
    scorer: PairScorer | None = None,
    generator: Generator | None = None,
    retrieve_top_k: int = RETRIEVE_TOP_K,
    rerank_top_k: int = RERANK_TOP_K,
    embed_model: str = "hash",
    llm_model: str = "",
) -> DataFrame:
    """Write and return the report. Without a generator the grounding part is skipped, and says so.

    The router's setting is the saved one, unless another is given.
    """
    if router_config is None:
        router_config = RouterConfig(**load_setting(spark, paths.router, ROUTER_CONFIG_SCHEMA))
    run = f"{work_dir(spark)}/eval-{uuid.uuid4().hex[:12]}"
    index = read_index(spark, paths.index)
    encoder = index_encoder(spark, encoder, paths.index)
    scorer = scorer or Bm25Scorer.from_stats(*saved_stats(index, f"{paths.index}.stats"))
    ranker = ModelRanker(load_model(paths.ranker))
    labelled, relevance, features = labelled_candidates(
        spark, paths.relevance_eval, index, encoder, scorer, retrieve_top_k
    )
    features = write_and_read(features, f"{run}/features")
    names = labelled.select("query_id", "seq", "query")
    per_query = evaluate_ranking(features, relevance, ranker, rerank_top_k).join(names, "query_id")
    per_query = write_and_read(per_query, f"{run}/per-query")
    ranking = ranking_summary(per_query).first().asDict()
    log_event(spark, paths.events, "eval", "reranker", **ranking)

    intents = with_file_order(read_jsonl(spark, paths.intents, INTENT))
    routing = write_and_read(
        evaluate_router(encoder.encode(intents, "query"), router_config), f"{run}/routing"
    )
    numbers = routing.first().asDict()
    numbers["per_class_f1"] = F.to_variant_object(
        F.create_map(*[F.lit(x) for pair in sorted(numbers["per_class_f1"].items()) for x in pair])
    )
    log_event(spark, paths.events, "eval", "intent", **numbers)

    grounding = None
    if generator is None:
        log_event(spark, paths.events, "eval", "grounding_skipped", "WARNING", reason="no generator given")
    else:
        scored = answer_and_score(names, rerank(features, ranker, rerank_top_k), generator)
        grounding = write_and_read(grounding_summary(scored), f"{run}/grounding")
        log_event(spark, paths.events, "eval", "grounding", **grounding.first().asDict())

    config = RunConfig(
        embed_model,
        llm_model,
        retrieve_top_k,
        rerank_top_k,
        paths.relevance_train,
        paths.relevance_eval,
        paths.intents,
    )
    rows_path = f"{paths.report}.per_query"
    write_per_query(per_query, rows_path)
    report = build_report(per_query, routing, grounding, config, rows_path)
    write_report(report, paths.report)
    return report
