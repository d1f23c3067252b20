"""Ranking features of (query, candidate) rows: dense score, pair score, lexical overlap.

A pair scorer has two methods: ``prepare(queries)`` adds what it needs to know of a query (computed
once per query, before the join with its hits) and ``score(candidates)`` adds ``pair_score`` to rows
holding ``query_id, query, text, text_tokens`` and the prepared columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.functions.text import bind, lower_bytes, overlap_of_sets, token_list, token_set, tokens_of

# The order in which a model sees the features.
FEATURES = ("dense_cosine", "cross_encoder_score", "lexical_overlap")

# The usual BM25 parameters.
K1 = 1.2
B = 0.75
# Different tokens that a task counts before it passes them on.
COUNTED_TOKENS = 250_000


class PairScorer(Protocol):
    def prepare(self, queries: DataFrame) -> DataFrame: ...

    def score(self, candidates: DataFrame) -> DataFrame: ...


def corpus_stats(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What BM25 needs to know of a corpus: ``token, df`` and one row ``n_chunks, n_tokens``.

    Built once per index. Frequencies are counted map-side before the shuffle, so a token that is
    in every chunk costs one row per task, or per ``COUNTED_TOKENS`` different ones.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.RecordBatch:
            # Tokens are ASCII.
            names = pa.array(list(found), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(list(found.values()), pa.int64())], ["token", "df"])

        found: Counter[bytes] = Counter()
        for batch in batches:
            for tokens in tokens_of(batch.column(0)):
                found.update(set(tokens))
                if len(found) >= COUNTED_TOKENS:
                    yield table()
                    found.clear()
        yield table()

    counted = chunks.select(lower_bytes(F.col("text"))).mapInArrow(count, "token string, df long")
    frequency = counted.groupBy("token").agg(F.sum("df").alias("df"))
    size = chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.sum(F.size(token_list(F.col("text")))), F.lit(0)).alias("n_tokens"),
    )
    return frequency, size


class Bm25Scorer:
    """Offline pair scorer: BM25 over distinct query tokens, divided by the query's best score.

    Idf values travel with the query row; term frequencies are counted inside the candidate row,
    so scoring itself shuffles nothing but the candidates' query id.
    """

    def __init__(self, frequency: DataFrame, n_chunks: int, n_tokens: int):
        self.frequency, self.n_chunks, self.n_tokens = frequency, n_chunks, n_tokens

    @classmethod
    def from_stats(cls, frequency: DataFrame, size: DataFrame) -> Bm25Scorer:
        row = size.first()
        return cls(frequency, row["n_chunks"], row["n_tokens"])

    def prepare(self, queries: DataFrame) -> DataFrame:
        """Add ``terms`` and ``term_idf``: the query's tokens that the corpus knows, in step."""
        tokens = queries.select("query_id", F.explode(token_set(F.col("query"))).alias("token"))
        n, df = F.lit(float(self.n_chunks)), F.col("df").cast("double")
        idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
        known = (
            tokens.join(self.frequency, "token")
            .groupBy("query_id")
            .agg(F.collect_list(F.struct("token", idf.alias("idf"))).alias("known"))
        )
        terms = known.select(
            "query_id", F.col("known.token").alias("terms"), F.col("known.idf").alias("term_idf")
        )
        return queries.join(terms, "query_id", "left")

    def score(self, candidates: DataFrame) -> DataFrame:
        average = self.n_tokens / self.n_chunks if self.n_chunks else 1.0
        terms, idf = F.col("terms"), F.col("term_idf")

        def bm25(tokens: Column) -> Column:
            length = F.size(tokens).cast("double")
            damp = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(average))

            def add(total: Column, token: Column) -> Column:
                tf = F.size(tokens) - F.size(F.array_remove(tokens, token))
                weight = F.element_at(idf, F.array_position(terms, token).cast("int"))
                return total + weight * F.lit(K1 + 1) / (F.lit(1.0) + damp / tf)

            return F.aggregate(F.array_intersect(tokens, terms), F.lit(0.0), add)

        best = F.max("_bm25").over(Window.partitionBy("query_id"))
        return (
            candidates.withColumn("_bm25", F.coalesce(bind(F.col("text_tokens"), bm25), F.lit(0.0)))
            .withColumn("_best", best)
            .withColumn("pair_score", F.when(F.col("_best") > 0, F.col("_bm25") / F.col("_best")).otherwise(0.0))
            .drop("terms", "term_idf", "_bm25", "_best")
        )


class BatchPairScorer:
    """Plug-in pair scorer: ``factory()`` builds a model that maps (query, text) pairs to floats.

    Built once per task; pairs arrive in Arrow batches.
    """

    def __init__(self, factory: Callable[[], Callable]):
        self.factory = factory

    def prepare(self, queries: DataFrame) -> DataFrame:
        return queries

    def score(self, candidates: DataFrame) -> DataFrame:
        factory = self.factory

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = factory()
            for query, text in batches:
                yield pd.Series(model(list(zip(query, text, strict=True))), dtype="float64")

        return candidates.withColumn("pair_score", run("query", "text"))


def with_query_tokens(queries: DataFrame) -> DataFrame:
    """Tokenise each query once, before it is joined with its hits."""
    return queries.withColumn("query_tokens", token_set(F.col("query")))


def rank_features(candidates: DataFrame, scorer: PairScorer) -> DataFrame:
    """Add the three feature columns to ``query_id, query, query_tokens, chunk_id, text, score``.

    A missing input column is an error before anything runs.
    """
    missing = {"query_id", "query", "query_tokens", "text", "score"} - set(candidates.columns)
    if missing:
        raise KeyError(f"candidates lack {sorted(missing)}")
    # Tokens of a passage serve both the overlap and the scorer; they are gone before any shuffle.
    tokenised = candidates.withColumn("text_tokens", token_list(F.col("text"))).withColumn(
        "lexical_overlap", overlap_of_sets(F.col("query_tokens"), F.col("text_tokens"))
    )
    return (
        scorer.score(tokenised)
        .withColumn("dense_cosine", F.col("score"))
        .withColumn("cross_encoder_score", F.col("pair_score"))
        .drop("pair_score", "query_tokens", "text_tokens")
    )


def ranking_examples(features: DataFrame, relevance: DataFrame) -> DataFrame:
    """Features plus a 0/1 ``label``. Queries without candidates have no rows and so drop out."""
    return label_candidates(features, relevance)


def label_candidates(candidates: DataFrame, relevance: DataFrame) -> DataFrame:
    """Add ``label``: 1.0 if the candidate's document is relevant to its query, else 0.0."""
    relevant = relevance.select("query_id", "doc_id").distinct().withColumn("_hit", F.lit(1.0))
    return (
        candidates.join(relevant, ["query_id", "doc_id"], "left")
        .withColumn("label", F.coalesce("_hit", F.lit(0.0)))
        .drop("_hit")
    )


def group_sizes(examples: DataFrame) -> DataFrame:
    return examples.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))
