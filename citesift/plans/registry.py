"""Named queries over the given tables, one per operator.

Each takes ``(spark, sf_dir)`` and returns a table with plain columns. Floating-point results are
rounded to six digits here, at the very end, and nowhere before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citesift.functions import prompts as P
from citesift.functions.citations import extract_citations
from citesift.functions.eventlog import event_json, utc_iso
from citesift.functions.text import token_set
from citesift.functions.vectors import l2_norm, l2_normalize
from citesift.operators import contracts, metrics, splits
from citesift.operators.blocks import topk
from citesift.operators.chunking import replicate_chunks
from citesift.operators.embedding import IdfEncoder
from citesift.operators.evaluation import RunConfig, build_report, evaluate_ranking
from citesift.operators.features import (
    corpus_stats,
    group_sizes,
    label_candidates,
    ranking_examples,
)
from citesift.operators.generation import ExtractiveGenerator, build_prompts
from citesift.operators.grounding import grounding_summary, score_answers, with_passages
from citesift.operators.latency import latency_summary
from citesift.operators.listwise import gradients
from citesift.operators.ltr import RankerConfig, best_trial, train_ranker
from citesift.operators.numbering import hash_bucket, hash_order, number_rows
from citesift.operators.rerank import LinearRanker, ModelRanker, passage_lists, rerank
from citesift.operators.routing import (
    CentroidRouter,
    LogisticRouter,
    RouterConfig,
    evaluate_router,
    holdout_predictions,
    train_router,
)
from citesift.operators.topk import dense_topk
from citesift.plans import tables as T
from citesift.plans.ask import RERANK_TOP_K, RETRIEVE_TOP_K, Assistant
from citesift.session import work_dir
from citesift.sources.index_store import read_index
from citesift.streaming.asks import stream_ask
from citesift.streaming.ingest import stream_into_index
from citesift.streaming.rollup import (
    latency_counts,
    read_window_counts,
    rollup,
    stream_latency_counts,
    stream_window_counts,
)

KNN = 10
DIGITS = 6
# Means of two-decimal values over few rows often end exactly on the half of the sixth digit.
MEAN_DIGITS = 9
REFUSED_LANGUAGE = "es"
DECLARED_ROLES = ["assistant", "tool", "user"]
FOLDS = 3
# Weights of (dense, pair score, overlap) that ``best_trial`` compares.
TRIAL_WEIGHTS = {
    "balanced": (0.5, 0.3, 0.2),
    "dense_only": (1.0, 0.0, 0.0),
    "overlap_only": (0.0, 0.0, 1.0),
    "pair_only": (0.0, 1.0, 0.0),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name; the trailing underscore of names in use is dropped."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def rounded(column: Column | str, name: str | None = None) -> Column:
    name = name or column
    return F.round(column, DIGITS).alias(name)


def count_of(column: Column | str, name: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint").alias(name)


# Chunks and ids


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(spark, sf_dir).select(
        "chunk_id", "doc_id", "source", count_of("chunk_index", "chunk_index"), "text"
    )


@query
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunks(spark, sf_dir).select("chunk_id")


@query
def chunk_id_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.chunk_id_counts(T.chunks(spark, sf_dir))


@query
def replicate_chunks_(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = T.index(spark, sf_dir)
    n = index.count()
    order = hash_order("chunk_id")
    numbered = number_rows(index.select("chunk_id"), [], [order, F.col("chunk_id")], hash_bucket(order))
    copies = replicate_chunks(index.drop("embedding"), numbered, n, 2 * n + n // 2)
    return copies.select("chunk_id", "doc_id", count_of("chunk_index", "chunk_index"), "copy")


# Text and vectors


@query
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.chunks(spark, sf_dir).select("chunk_id", F.array_sort(token_set(F.col("text"))).alias("t"))
    return tokens.select(
        "chunk_id", count_of(F.size("t"), "n_tokens"), F.array_join("t", " ").alias("tokens")
    )


@query
def corpus_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats(T.chunks(spark, sf_dir))[0]


@query
def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_stats(T.chunks(spark, sf_dir))[1]


@query
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = T.ENCODER.encode(T.chunks(spark, sf_dir)).select("chunk_id", "embedding")
    return vectors.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight")).where(
        F.col("weight") > 0
    ).select("chunk_id", count_of("bucket", "bucket"), rounded(F.col("weight").cast("double"), "weight"))


@query
def hash_embed_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = T.chunks(spark, sf_dir).select("chunk_id", "text")
    _, vectors = IdfEncoder(T.ENCODER.dim).fit_encode(chunks)
    return vectors.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight")).where(
        F.col("weight") > 0
    ).select("chunk_id", count_of("bucket", "bucket"), rounded(F.col("weight").cast("double"), "weight"))


@query
def l2_normalize_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    unit = rows.select("vec_id", scaled.alias("v")).select(
        "vec_id", l2_norm(F.col("v")).alias("norm"), F.posexplode(l2_normalize(F.col("v"))).alias("pos", "x")
    )
    return unit.select("vec_id", count_of("pos", "pos"), rounded("norm"), rounded("x"))


# Index and search


@query
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = T.chunks(spark, sf_dir)
    vectors = T.ENCODER.encode(chunks).select("chunk_id", "embedding")
    joined = contracts.align_vectors(chunks, vectors)
    return joined.select(
        "chunk_id",
        "doc_id",
        count_of("chunk_index", "chunk_index"),
        count_of(F.size("embedding"), "dim"),
        rounded(F.array_max("embedding").cast("double"), "peak"),
    )


@query
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.index_stats(T.index(spark, sf_dir))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", count_of("rank", "rank"), "chunk_id", rounded("score"))


@query
def dense_topk_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(topk(T.embedded_queries(spark, sf_dir), T.blocked_index(spark, sf_dir), RETRIEVE_TOP_K))


@query
def dense_topk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index without blocks."""
    return _hits(dense_topk(T.embedded_queries(spark, sf_dir), T.index(spark, sf_dir), RETRIEVE_TOP_K))


def _class_means(rows: DataFrame, label: str) -> DataFrame:
    mean = Summarizer.mean(array_to_vector("embedding"))
    return rows.groupBy(label).agg(vector_to_array(mean, "float32").alias("embedding"))


@query
def dense_topk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors nearest to the mean of each of their labels."""
    means = _class_means(T.table(spark, sf_dir, "embeddings"), "label")
    return _hits(topk(means.withColumnRenamed("label", "query_id"), T.blocked_vectors(spark, sf_dir), KNN))


@query
def dense_topk_k_gt_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the mean vector of each language: fewer entries than k."""
    documents = T.labelled_documents(spark, sf_dir)
    means = _class_means(documents, "intent")
    index = means.select(
        F.col("intent").alias("chunk_id"), F.col("intent").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding"
    )
    return _hits(dense_topk(documents, index, KNN))


# Features, labels, ranking


@query
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.features(spark, sf_dir).select("query_id", "chunk_id", rounded("lexical_overlap"))


@query
def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citesift.operators.evaluation import candidates

    found = candidates(
        T.embedded_queries(spark, sf_dir), T.blocked_index(spark, sf_dir), RETRIEVE_TOP_K, T.scorer(spark, sf_dir)
    )
    return found.select(
        "query_id",
        "chunk_id",
        rounded("dense_cosine"),
        rounded("cross_encoder_score"),
        rounded("lexical_overlap"),
    )


@query
def relevant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citesift.operators.relevance import relevant_documents as find

    return find(T.queries(spark, sf_dir), T.documents(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_candidates(T.features(spark, sf_dir), T.relevance(spark, sf_dir))


@query
def label_candidates_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("query_id", count_of("rank", "rank"), "chunk_id", "label")


@query
def ranking_examples_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking_examples(T.features(spark, sf_dir), T.relevance(spark, sf_dir))
    return rows.select(
        "query_id",
        "seq",
        count_of("rank", "rank"),
        rounded("dense_cosine"),
        rounded("cross_encoder_score"),
        rounded("lexical_overlap"),
        "label",
    )


@query
def group_sizes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sizes(T.features(spark, sf_dir))


def _reranked(spark: SparkSession, sf_dir: str, k: int | None = RERANK_TOP_K) -> DataFrame:
    return rerank(T.features(spark, sf_dir), LinearRanker(), k)


@query
def rerank_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select(
        "query_id", count_of("rerank_rank", "rerank_rank"), "chunk_id", rounded("rerank_score")
    )


class _OverlapOnly:
    """Scores by overlap in tenths: many ties."""

    def score(self, features: DataFrame) -> DataFrame:
        return features.withColumn("rerank_score", F.floor(F.col("lexical_overlap") * 10) / 10)


@query
def rerank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank(T.features(spark, sf_dir), _OverlapOnly()).select(
        "query_id", count_of("rerank_rank", "rerank_rank"), "chunk_id", rounded("rerank_score")
    )


# Ranking metrics


@query
def dcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dcg(_labelled(spark, sf_dir)).select("query_id", rounded("dcg"))


@query
def ndcg_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg_at_k(_labelled(spark, sf_dir), 5).select("query_id", rounded("ndcg"))


@query
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mrr(_labelled(spark, sf_dir)).select("query_id", rounded("mrr"))


@query
def recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.recall_at_k(_labelled(spark, sf_dir), T.relevance(spark, sf_dir), 5)
    return found.select("query_id", rounded("recall"))


@query
def mean_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = LinearRanker().score(_labelled(spark, sf_dir))
    return metrics.mean_ndcg(scored, 5, "rerank_score").select(rounded("mean_ndcg"))


def _per_query(spark: SparkSession, sf_dir: str, ranker=None) -> DataFrame:
    compared = evaluate_ranking(
        T.features(spark, sf_dir), T.relevance(spark, sf_dir), ranker or LinearRanker(), RERANK_TOP_K
    )
    return compared.join(T.queries(spark, sf_dir), "query_id")


@query
def eval_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.ranking_summary(_per_query(spark, sf_dir))
    return summary.select(
        *[rounded(m) for m in metrics.MEANS], "n_improved", "n_regressed", "n_tied", "n_queries"
    )


@query
def rerank_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_query(spark, sf_dir).select(
        "query_id", rounded("dense_ndcg"), rounded("reranked_ndcg"), rounded("delta")
    )


@query
def uplift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.uplift_summary(_per_query(spark, sf_dir))


@query
def uplift_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.uplift_extremes(_per_query(spark, sf_dir)).select(
        "worst_query", rounded("worst_delta"), "best_query", rounded("best_delta")
    )


@query
def best_trial_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean nDCG of several weightings, all ranked in one plan, and the best of them."""
    weights = F.array(
        *[
            F.struct(F.lit(name).alias("trial"), *[F.lit(x).alias(c) for c, x in zip("dpo", w, strict=True)])
            for name, w in TRIAL_WEIGHTS.items()
        ]
    )
    scored = _labelled(spark, sf_dir).select(
        F.explode(weights).alias("w"),
        "query_id",
        "rank",
        "label",
        "dense_cosine",
        "cross_encoder_score",
        "lexical_overlap",
    )
    score = (
        F.col("w.d") * F.col("dense_cosine")
        + F.col("w.p") * F.col("cross_encoder_score")
        + F.col("w.o") * F.col("lexical_overlap")
    )
    order = Window.partitionBy("trial", "query_id").orderBy(F.desc("score"), "rank")
    ranked = (
        scored.withColumn("trial", F.col("w.trial"))
        .withColumn("score", score.cast("float"))
        .withColumn("new_rank", F.row_number().over(order))
    )
    per_query = (
        metrics.with_ideal_rank(ranked, ("trial", "query_id"))
        .groupBy("trial", "query_id")
        .agg(metrics.ndcg_column(5, "new_rank").alias("ndcg"))
    )
    trials = per_query.groupBy("trial").agg(F.round(F.avg("ndcg"), DIGITS).alias("metric"))
    return best_trial(trials)


# Routing


@query
def route_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.labelled_documents(spark, sf_dir)
    routed = CentroidRouter.fit(rows).route(rows.select("query_id", "embedding"))
    return routed.select("query_id", "intent", rounded("confidence"))


def _routed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.labelled_documents(spark, sf_dir).withColumnRenamed("intent", "label")
    return CentroidRouter.fit(rows, "label").route(rows).withColumnRenamed("intent", "prediction")


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_routed_documents(spark, sf_dir))


@query
def f1_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.f1_per_class(metrics.confusion(_routed_documents(spark, sf_dir)))
    return found.select("class", "support", "hits", rounded("f1"))


@query
def f1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.f1_report(_routed_documents(spark, sf_dir))
    return report.select(rounded("macro_f1"), rounded("accuracy"), "n_test")


def _assistant(spark: SparkSession, sf_dir: str) -> Assistant:
    return Assistant(
        index=T.blocked_index(spark, sf_dir),
        encoder=T.ENCODER,
        router=CentroidRouter.fit(T.labelled_documents(spark, sf_dir)),
        scorer=T.scorer(spark, sf_dir),
        ranker=LinearRanker(),
        generator=ExtractiveGenerator(),
        refuse=REFUSED_LANGUAGE,
    )


@query
def guardrail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _assistant(spark, sf_dir).route(T.asked(spark, sf_dir))
    return routed.select("query_id", "intent", (F.col("intent") == REFUSED_LANGUAGE).alias("refused"))


@query
def route_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.labelled_documents(spark, sf_dir)
    trained = train_router(rows)
    return LogisticRouter(trained.model).route(rows.select("query_id", "embedding")).select(
        "query_id", "intent", rounded("confidence")
    )


@query
def route_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate_router(T.labelled_documents(spark, sf_dir), RouterConfig(10.0, True))
    return report.select(
        rounded("holdout_macro_f1"),
        rounded("holdout_accuracy"),
        F.to_json("per_class_f1").alias("per_class_f1"),
        "n_test",
    )


# Splits


@query
def val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = T.features(spark, sf_dir).select("query_id", "seq").distinct()
    return splits.prefix_split(kept).select("query_id", "position", "is_validation")


@query
def strat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.stratified_holdout(rows, "lang", "doc_id").select("doc_id", "lang", "is_test")


@query
def fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.stratified_folds(rows, "lang", "doc_id", FOLDS).select(
        "doc_id", "lang", count_of("fold", "fold")
    )


@query
def fold_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = splits.class_counts(T.table(spark, sf_dir, "documents"), "lang")
    return splits.fold_count(counts, FOLDS)


@query
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in alphabetical order with their code; one row per class."""
    counts = splits.class_counts(T.table(spark, sf_dir, "documents"), "lang")
    code = F.dense_rank().over(Window.orderBy("label")) - 1
    return counts.select("label", "n", count_of(code, "code"))


@query
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").select("doc_id", "lang", contracts.text_digest("text"))
    split = splits.stratified_holdout(rows, "lang", "doc_id").select("is_test", "text_digest")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    return train.select("text_digest").intersect(test.select("text_digest"))


@query
def vocab_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = T.table(spark, sf_dir, "conversations").select(F.col("role").alias("label"))
    return contracts.vocabulary_drift(roles, DECLARED_ROLES)


@query
def dangling_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against documents, in both directions."""
    documents = T.documents(spark, sf_dir).select("doc_id")
    labels = T.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    referenced = labels.unionByName(T.relevance(spark, sf_dir).select("doc_id"))
    missing = contracts.dangling_references(referenced, documents)
    unused = contracts.dangling_references(documents, referenced)
    return missing.withColumn("kind", F.lit("missing")).unionByName(unused.withColumn("kind", F.lit("unlabelled")))


# Prompts, answers, citations


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_passages(T.queries(spark, sf_dir), _reranked(spark, sf_dir))


@query
def format_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select("query_id", P.format_passages(F.col("passages")).alias("sources"))


@query
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = build_prompts(_passages(spark, sf_dir))
    return prompts.select(
        "query_id",
        F.col("system")[0]["text"].alias("system"),
        F.col("system")[0]["cache_control"]["type"].alias("cache"),
        F.col("messages")[0]["role"].alias("role"),
        F.col("messages")[0]["content"].alias("content"),
    )


@query
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _passages(spark, sf_dir).select("query_id", P.source_list(F.col("passages")).alias("s"))
    return listed.select(
        "query_id",
        F.array_join(F.transform("s", lambda p: F.concat_ws("|", p.chunk_id, p.source)), ",").alias("sources"),
    )


@query
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExtractiveGenerator().answer(_passages(spark, sf_dir)).select("query_id", "answer")


@query
def join_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a reply: lines that hold digits are tool blocks, the others text blocks."""
    turns = T.table(spark, sf_dir, "conversations")
    blocks = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.when(F.rlike(line, F.lit("[0-9]")), "tool_use").otherwise("text").alias("type"),
            line.alias("text"),
        ),
    )
    return turns.select("conv_id", "turn", P.join_text_blocks(blocks).alias("answer"))


@query
def extract_citations_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as an answer that cites its id, its document only, and the id without its hash."""
    chunk_id = F.col("chunk_id")
    answer = F.concat(
        F.col("text"), F.lit(" ["), chunk_id, F.lit("; "), F.col("doc_id"), F.lit("] ["), chunk_id, F.lit(","),
        F.substring_index(chunk_id, "-", 1), F.lit("]"),
    )
    cited = T.chunks(spark, sf_dir).select(
        "chunk_id", F.posexplode(extract_citations(answer)).alias("position", "citation")
    )
    return cited.select("chunk_id", count_of("position", "position"), "citation")


def _scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that quote the best retrieved passages, judged against the re-ranked ones."""
    all_ranked = _reranked(spark, sf_dir, None)
    retrieved = all_ranked.where(F.col("rank") <= RERANK_TOP_K)
    given = passage_lists(all_ranked.where(F.col("rerank_rank") <= RERANK_TOP_K))
    ids = given.select("query_id", F.transform("passages", lambda p: p.chunk_id).alias("provided_ids"))
    answered = ExtractiveGenerator().answer(with_passages(T.queries(spark, sf_dir), retrieved, "rank"))
    return score_answers(answered.join(ids, "query_id", "left"))


@query
def grounding_score_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_answers(spark, sf_dir).select(
        "query_id", "has_citation", rounded("valid_fraction"), count_of("n_citations", "n_citations")
    )


@query
def grounding_summary_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding_summary(_scored_answers(spark, sf_dir)).select(
        rounded("mean_valid_citation_fraction"), rounded("answers_with_citation"), "n_queries"
    )


# Events


@query
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events")
    line = event_json(
        F.lit("serve"),
        F.col("event_type"),
        ts=utc_iso(F.col("ts")),
        level=F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"),
        fields={"user_id": F.col("user_id"), "value": F.col("value"), "ts": F.lit("overwritten")},
        open_fields=F.from_json("props", "map<string, variant>"),
    )
    return events.select("event_id", line.alias("line"))


@query
def latency_summary_(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("latency_ms"))
    found = latency_summary(events, ["event_type"])
    return found.select("event_type", "n", rounded("p50"), rounded("p95"), F.round("mean", MEAN_DIGITS).alias("mean"))


@query
def latency_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every seventh user have no type, those of every fifth no latency."""
    user = F.col("user_id")
    events = T.table(spark, sf_dir, "events").select(
        F.when(user % 7 != 0, F.col("event_type")).alias("kind"),
        F.when(user % 5 != 0, F.col("value")).alias("latency_ms"),
    )
    found = latency_summary(events, ["kind"])
    return found.select("kind", "n", rounded("p50"), rounded("p95"), F.round("mean", MEAN_DIGITS).alias("mean"))


@query
def event_lines_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines where every third event lost its open fields and every fourth has broken ones."""
    events = T.table(spark, sf_dir, "events")
    props = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 4 == 0, "{broken")
    line = event_json(
        F.lit("serve"),
        F.col("event_type"),
        ts=utc_iso(F.col("ts")),
        fields={"user_id": F.col("user_id")},
        open_fields=F.from_json(props.otherwise(F.col("props")), "map<string, variant>"),
    )
    return events.select("event_id", line.alias("line"))


def _rollup_columns(found: DataFrame) -> DataFrame:
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "intent",
        "n",
        rounded("refusal_rate"),
        rounded("p50"),
        rounded("p95"),
        F.round("mean", MEAN_DIGITS).alias("mean"),
    )


@query
def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup_columns(rollup(latency_counts(T.served_events(spark, sf_dir))))


# Whole runs


def _flat_answers(answers: DataFrame) -> DataFrame:
    return answers.select(
        "query_id",
        "intent",
        rounded("confidence"),
        F.md5(F.col("answer").cast("binary")).alias("answer_md5"),
        F.array_join(F.transform("sources", lambda s: s.chunk_id), ",").alias("sources"),
    )


@query
def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_answers(_assistant(spark, sf_dir).ask(T.asked(spark, sf_dir)))


def _ranker_training(spark: SparkSession, sf_dir: str):
    configs = [RankerConfig("trees", step_size=0.1, depth=3, rounds=20), RankerConfig("linear", reg=0.001)]
    return train_ranker(_labelled(spark, sf_dir), configs=configs)


@query
def rerank_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = _ranker_training(spark, sf_dir)
    return rerank(T.features(spark, sf_dir), ModelRanker(trained.model), RERANK_TOP_K).select(
        "query_id", count_of("rerank_rank", "rerank_rank"), "chunk_id", rounded("rerank_score")
    )


@query
def listwise_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient and curvature of nDCG for the retrieved order of every labelled query."""
    rows = _labelled(spark, sf_dir).select(
        "query_id", F.col("rank").alias("place"), F.lit(0).alias("features"), "label", F.col("dense_cosine").alias("score")
    )
    found = gradients(rows)
    return found.select("query_id", count_of("place", "rank"), rounded("g", "pull"), rounded("h", "curvature"))


@query
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_query = _per_query(spark, sf_dir)
    predictions = holdout_predictions(T.labelled_documents(spark, sf_dir), RouterConfig(10.0, True))
    routing = metrics.f1_report(predictions, "actual", "predicted")
    grounding = grounding_summary(_scored_answers(spark, sf_dir))
    config = RunConfig(
        f"hash-{T.ENCODER.dim}", "extractive", RETRIEVE_TOP_K, RERANK_TOP_K, "benchmark", "benchmark", "documents"
    )
    report = build_report(per_query, routing, grounding, config)
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


# Streams


def _stream_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/streams/{name}-{uuid.uuid4().hex[:8]}"


def _stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files.

    A stream reads a path of one file only if the path is a pattern; the brackets make it one, of itself.
    """
    schema = T.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


@query
def stream_index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citesift.sources.corpus import documents_from_table

    folder = _stream_folder(spark, "index")
    incoming = documents_from_table(_stream_of(spark, sf_dir, "documents"))
    cores = spark.sparkContext.defaultParallelism
    stream_into_index(
        incoming, T.ENCODER, f"{folder}/out", f"{folder}/checkpoint", partitions=cores
    ).awaitTermination()
    return read_index(spark, f"{folder}/out").select(
        "chunk_id", "doc_id", count_of("chunk_index", "chunk_index"), count_of(F.size("embedding"), "dim")
    )


@query
def stream_ask_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stream_folder(spark, "ask")
    turns = _stream_of(spark, sf_dir, "conversations")
    incoming = T.user_turns(turns)
    stream_ask(
        incoming, _assistant(spark, sf_dir), f"{folder}/answers", f"{folder}/events", f"{folder}/checkpoint"
    ).awaitTermination()
    return _flat_answers(spark.read.parquet(f"{folder}/answers"))


@query
def stream_event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, open ones too."""
    folder = _stream_folder(spark, "rollup")
    incoming = T.as_served(_stream_of(spark, sf_dir, "events"))
    stream_window_counts(incoming, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _rollup_columns(rollup(read_window_counts(spark, f"{folder}/out")))


@query
def stream_event_rollup_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stream_folder(spark, "rollup-closed")
    incoming = T.as_served(_stream_of(spark, sf_dir, "events"))
    stream_latency_counts(incoming, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _rollup_columns(rollup(spark.read.parquet(f"{folder}/out")))
