"""Open an assistant from what training has saved."""

from __future__ import annotations

from pyspark.sql import SparkSession

from citesift.operators.embedding import Encoder
from citesift.operators.features import Bm25Scorer, PairScorer
from citesift.operators.generation import Generator
from citesift.operators.rerank import ModelRanker
from citesift.operators.routing import LogisticRouter
from citesift.plans.ask import Assistant
from citesift.plans.ingest import saved_stats
from citesift.plans.train import Paths
from citesift.sources.encoders import index_encoder
from citesift.sources.index_store import read_index
from citesift.sources.models import load_model


def open_assistant(
    spark: SparkSession,
    paths: Paths,
    encoder: Encoder,
    generator: Generator,
    scorer: PairScorer | None = None,
    **options: object,
) -> Assistant:
    """Index, statistics, ranker and router by their paths. ``options`` are those of ``Assistant``."""
    index = read_index(spark, paths.index)
    encoder = index_encoder(spark, encoder, paths.index)
    scorer = scorer or Bm25Scorer.from_stats(*saved_stats(index, f"{paths.index}.stats"))
    return Assistant(
        index,
        encoder,
        LogisticRouter(load_model(paths.router)),
        scorer,
        ModelRanker(load_model(paths.ranker)),
        generator,
        **options,
    )
