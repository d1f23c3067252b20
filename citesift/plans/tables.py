"""The given tables in the roles the operators expect, and the tables derived from them.

The derived ones (index, statistics, candidates) are what ingest and evaluation jobs write once and
everything else reads; here they are written per session below the shared work folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.functions.text import strip
from citesift.operators.blocks import BlockedIndex
from citesift.operators.chunking import chunk_documents
from citesift.operators.embedding import HashEncoder
from citesift.operators.evaluation import candidates
from citesift.operators.features import Bm25Scorer, corpus_stats
from citesift.operators.relevance import relevant_documents
from citesift.plans.ask import RETRIEVE_TOP_K
from citesift.session import spread, work_dir, write_and_read
from citesift.sources.block_store import write_blocked_index
from citesift.sources.corpus import documents_from_table
from citesift.sources.index_store import INDEX_SCHEMA

ENCODER = HashEncoder()

_written: dict[tuple[str, str, str], DataFrame] = {}
_blocked: dict[tuple[str, str, str], BlockedIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The derived table ``name``, written the first time a session asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        place = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
        _written[key] = write_and_read(build(), f"{work_dir(spark)}/{place}/{name}")
    return _written[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return documents_from_table(spread(rows))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(documents(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return ENCODER.encode(chunks(spark, sf_dir)).select(INDEX_SCHEMA.names)

    return written(spark, sf_dir, "index", build)


def blocked(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> BlockedIndex:
    """The index ``name``, a table that is stored, in blocks, written the first time a session asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _blocked:
        place = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
        _blocked[key] = write_blocked_index(build(), f"{work_dir(spark)}/{place}/blocked-{name}", stored=True)
    return _blocked[key]


def blocked_index(spark: SparkSession, sf_dir: str) -> BlockedIndex:
    return blocked(spark, sf_dir, "index", lambda: index(spark, sf_dir))


def blocked_vectors(spark: SparkSession, sf_dir: str) -> BlockedIndex:
    return blocked(spark, sf_dir, "vectors", lambda: vectors(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled queries: every benchmark passage, whole."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.col("item_id").alias("seq"),
        strip(F.col("text")).alias("query"),
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries put by users: every user turn of the conversations, whole."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return user_turns(spread(turns))


def user_turns(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), strip(F.col("text")).alias("query")
    )


def embedded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENCODER.encode(queries(spark, sf_dir), "query")


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(
        spark,
        sf_dir,
        "relevance",
        lambda: relevant_documents(queries(spark, sf_dir), documents(spark, sf_dir)),
    )


def scorer(spark: SparkSession, sf_dir: str) -> Bm25Scorer:
    found = index(spark, sf_dir)
    frequency = written(spark, sf_dir, "frequency", lambda: corpus_stats(found)[0])
    size = written(spark, sf_dir, "size", lambda: corpus_stats(found)[1])
    return Bm25Scorer.from_stats(frequency, size)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved and featurised candidates of the labelled queries."""
    return written(
        spark,
        sf_dir,
        "features",
        lambda: candidates(
            embedded_queries(spark, sf_dir),
            blocked_index(spark, sf_dir),
            RETRIEVE_TOP_K,
            scorer(spark, sf_dir),
        ),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language as the class to route by, and their vectors."""

    def build() -> DataFrame:
        scan = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
        rows = scan.select(
            F.col("doc_id").cast("string").alias("query_id"),
            F.col("lang").alias("intent"),
            F.col("text").alias("query"),
        )
        return ENCODER.encode(rows, "query").drop("query")

    return written(spark, sf_dir, "labelled_documents", build)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given embeddings as an index: every vector is a one-chunk document."""
    name = F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(
        name.alias("chunk_id"), name.alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding"
    )


def served_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_served(table(spark, sf_dir, "events"))


def as_served(events: DataFrame) -> DataFrame:
    """Log events in the shape of served queries."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("intent"),
        (F.col("event_type") == "error").alias("refused"),
        F.col("value").alias("latency_ms"),
    )
