"""Ask: a table of queries to cited answers, refusals first."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.functions.eventlog import event_json
from citesift.functions.prompts import REFUSAL, source_list
from citesift.operators.blocks import BlockedIndex
from citesift.operators.contracts import check_depths
from citesift.operators.embedding import Encoder
from citesift.operators.evaluation import candidates
from citesift.operators.features import PairScorer
from citesift.operators.generation import Generator
from citesift.operators.grounding import with_passages
from citesift.operators.guardrail import admitted, refused
from citesift.operators.rerank import Ranker, rerank
from citesift.operators.routing import OUT_OF_SCOPE, Router
from citesift.session import work_dir, write_and_read
from citesift.sources.eventlog import append_lines

RETRIEVE_TOP_K = 50
RERANK_TOP_K = 5


@dataclass
class Assistant:
    """Everything ``ask`` needs, opened once."""

    index: DataFrame | BlockedIndex
    encoder: Encoder
    router: Router
    scorer: PairScorer
    ranker: Ranker
    generator: Generator
    retrieve_top_k: int = RETRIEVE_TOP_K
    rerank_top_k: int = RERANK_TOP_K
    refuse: str = OUT_OF_SCOPE
    pilot_fraction: float | None = None

    def __post_init__(self) -> None:
        check_depths(self.retrieve_top_k, self.rerank_top_k)

    def route(self, queries: DataFrame) -> DataFrame:
        """``query_id, query, embedding, intent, confidence``."""
        return self.router.route(self.encoder.encode(queries, "query"))

    def ask(self, queries: DataFrame) -> DataFrame:
        """``query_id, intent, confidence, answer, sources`` for ``query_id, query``.

        Only admitted queries are searched. One that finds nothing is still answered, from an
        empty list of passages. The routed queries are written once: search, features, prompts and
        refusals all read them, and none of these encodes or routes again.
        """
        place = f"{work_dir(queries.sparkSession)}/asked/{uuid.uuid4().hex}"
        routed = write_and_read(self.route(queries), place)
        kept = admitted(routed, self.refuse).select("query_id", "query", "embedding", "intent", "confidence")
        features = candidates(
            kept.select("query_id", "query", "embedding"),
            self.index,
            self.retrieve_top_k,
            self.scorer,
            self.pilot_fraction,
        )
        ranked = rerank(features, self.ranker, self.rerank_top_k)
        answered = self.generator.answer(with_passages(kept.drop("embedding"), ranked)).select(
            "query_id", "intent", "confidence", "answer", source_list(F.col("passages")).alias("sources")
        )
        turned_away = refused(routed, self.refuse).select(
            "query_id",
            "intent",
            "confidence",
            F.lit(REFUSAL).alias("answer"),
            F.array().cast(answered.schema["sources"].dataType).alias("sources"),
        )
        return turned_away.unionByName(answered)


def ask_and_log(assistant: Assistant, queries: DataFrame, answers_path: str, events_path: str) -> DataFrame:
    """Answer a table of queries, save the answers and append one event for each.

    An event carries its share of the time that all answers took. Answers are written first: a run that breaks
    off logs nothing.
    """
    started = time.perf_counter()
    answers = write_and_read(assistant.ask(queries), answers_path)
    elapsed_ms = (time.perf_counter() - started) * 1000
    append_lines(ask_events(answers, elapsed_ms / max(1, answers.count()), assistant.refuse), events_path)
    return answers


def ask_events(answers: DataFrame, latency_ms: float, refuse: str = OUT_OF_SCOPE) -> DataFrame:
    """One event line per answer. Queries are answered as a batch; ``latency_ms`` is their share."""
    turned_away = F.col("intent") == refuse
    return answers.select(
        event_json(
            F.lit("serve"),
            F.lit("ask"),
            fields={
                "intent": F.col("intent"),
                "confidence": F.col("confidence"),
                "refused": turned_away,
                "n_sources": F.when(~turned_away, F.size("sources")),
                "latency_ms": F.lit(latency_ms),
            },
        ).alias("value")
    )
