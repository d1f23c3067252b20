"""Train: index if missing, fit ranker and router, save both, log the result."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from citesift.operators.contracts import check_training_sets, check_vocabulary
from citesift.operators.embedding import Encoder
from citesift.operators.evaluation import candidates
from citesift.operators.features import Bm25Scorer, PairScorer, ranking_examples
from citesift.operators.ltr import RankerTraining, train_ranker
from citesift.operators.ltr import TRIALS as RANKER_TRIALS
from citesift.operators.routing import TRIALS as ROUTER_TRIALS
from citesift.operators.routing import RouterTraining, train_router
from citesift.plans.ask import RETRIEVE_TOP_K
from citesift.plans.ingest import build_corpus_index, saved_stats
from citesift.session import work_dir, write_and_read
from citesift.sources.encoders import index_encoder
from citesift.sources.eventlog import log_event
from citesift.sources.index_store import index_exists, read_index
from citesift.sources.labels import INTENT, RELEVANCE, read_jsonl, relevance_pairs, with_file_order
from citesift.sources.models import save_model, save_setting


@dataclass(frozen=True)
class Paths:
    corpus: str
    index: str
    relevance_train: str
    relevance_eval: str
    intents: str
    ranker: str
    router: str
    report: str
    events: str


def open_or_build_index(spark: SparkSession, paths: Paths, encoder: Encoder) -> DataFrame:
    """The saved index; one is built only where there is no table at all, so none is ever lost."""
    if index_exists(spark, paths.index):
        return read_index(spark, paths.index)
    return build_corpus_index(spark, paths.corpus, encoder, paths.index, events_path=paths.events)


def labelled_candidates(
    spark: SparkSession, path: str, index: DataFrame, encoder: Encoder, scorer: PairScorer, k: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The labelled queries of a file, their relevance pairs and their featurised candidates."""
    labelled = with_file_order(read_jsonl(spark, path, RELEVANCE))
    # The order of the file is found once; the labels are read by the search, the pairs and the report.
    labelled = write_and_read(labelled, f"{work_dir(spark)}/labelled/{uuid.uuid4().hex}")
    queries = encoder.encode(labelled.select("query_id", "seq", "query"), "query")
    return labelled, relevance_pairs(labelled), candidates(queries, index, k, scorer)


def train_models(
    spark: SparkSession,
    paths: Paths,
    encoder: Encoder,
    scorer: PairScorer | None = None,
    retrieve_top_k: int = RETRIEVE_TOP_K,
    ranker_trials: int = RANKER_TRIALS,
    router_trials: int = ROUTER_TRIALS,
    intents: list[str] | None = None,
) -> tuple[RankerTraining, RouterTraining]:
    """The ranker trains on candidates of the depth it will later reorder.

    Labels are checked before anything is trained: train and held-out queries are disjoint, every relevant
    document is indexed, and the intents are those of ``intents``, if given.
    """
    index = open_or_build_index(spark, paths, encoder)
    encoder = index_encoder(spark, encoder, paths.index)
    scorer = scorer or Bm25Scorer.from_stats(*saved_stats(index, f"{paths.index}.stats"))
    labelled, relevance, features = labelled_candidates(
        spark, paths.relevance_train, index, encoder, scorer, retrieve_top_k
    )
    held_out = with_file_order(read_jsonl(spark, paths.relevance_eval, RELEVANCE))
    references = relevance.select("doc_id").unionByName(relevance_pairs(held_out).select("doc_id"))
    check_training_sets(labelled, held_out, references, index)
    labelled_intents = with_file_order(read_jsonl(spark, paths.intents, INTENT))
    if intents is not None:
        check_vocabulary(labelled_intents.withColumnRenamed("intent", "label"), intents)
    # The trials read the candidates many times; written, they are searched only once.
    features = write_and_read(features, f"{work_dir(spark)}/train-{uuid.uuid4().hex[:12]}/features")
    ranker = train_ranker(ranking_examples(features, relevance), ranker_trials)
    save_model(ranker.model, paths.ranker)

    router = train_router(encoder.encode(labelled_intents, "query"), trials=router_trials)
    save_model(router.model, paths.router)
    save_setting(spark, asdict(router.config), paths.router)
    log_event(
        spark,
        paths.events,
        "train",
        "models_trained",
        reranker_val_ndcg=ranker.val_ndcg,
        intent_cv_f1=router.cv_f1,
    )
    return ranker, router
