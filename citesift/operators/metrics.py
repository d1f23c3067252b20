"""Ranking metrics as relational aggregates over ``query_id, rank, label`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how much nDCG must move to count as moved.
UPLIFT_TOLERANCE = 1e-9


def gain(label: Column, rank: Column) -> Column:
    """Discounted gain of one result at a 1-based rank."""
    return label / F.log2(rank.cast("double") + 1.0)


def dcg(ranked: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id, dcg`` over the first k ranks (all ranks if k is None)."""
    cut = ranked if k is None else ranked.where(F.col("rank") <= k)
    return cut.groupBy("query_id").agg(F.sum(gain(F.col("label"), F.col("rank"))).alias("dcg"))


def with_ideal_rank(ranked: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("label"), "rank")
    return ranked.withColumn("ideal_rank", F.row_number().over(order))


def ndcg_column(k: int, rank: str = "rank") -> Column:
    """Aggregate: nDCG@k of a group with ``rank``, ``ideal_rank`` and ``label``; 0 if none is relevant.

    The ideal order uses the retrieved labels, so it measures ordering and not recall.
    """

    def total(position: str) -> Column:
        return F.sum(F.when(F.col(position) <= k, gain(F.col("label"), F.col(position))).otherwise(0.0))

    return F.coalesce(total(rank) / F.nullif(total("ideal_rank"), F.lit(0.0)), F.lit(0.0))


def mrr_column(rank: str = "rank") -> Column:
    """Aggregate: 1 / rank of the first relevant result, at any depth; 0 if there is none."""
    return F.coalesce(F.lit(1.0) / F.min(F.when(F.col("label") > 0, F.col(rank))), F.lit(0.0))


def recalled_docs_column(k: int, rank: str = "rank") -> Column:
    """Aggregate: distinct relevant documents among the first k chunks."""
    return F.count_distinct(F.when((F.col(rank) <= k) & (F.col("label") > 0), F.col("doc_id")))


def ndcg_at_k(ranked: DataFrame, k: int) -> DataFrame:
    return with_ideal_rank(ranked).groupBy("query_id").agg(ndcg_column(k).alias("ndcg"))


def mrr(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("query_id").agg(mrr_column().alias("mrr"))


def relevant_counts(relevance: DataFrame) -> DataFrame:
    return relevance.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_relevant"))


def recall_at_k(ranked: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """Share of a query's relevant documents found in its first k chunks; 0 if it has none."""
    found = ranked.groupBy("query_id").agg(recalled_docs_column(k).alias("found"))
    return found.join(relevant_counts(relevance), "query_id", "left").select(
        "query_id", recall_ratio(F.col("found"), F.col("n_relevant")).alias("recall")
    )


def recall_ratio(found: Column, n_relevant: Column) -> Column:
    return F.coalesce(found.cast("double") / n_relevant, F.lit(0.0))


def mean_ndcg(scored: DataFrame, k: int, score: str = "prediction") -> DataFrame:
    """Mean nDCG@k after sorting each query's rows by ``score``; ties keep the incoming ``rank``.

    One row ``mean_ndcg``; 0 when there are no queries.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "rank")
    ranked = scored.withColumn("new_rank", F.row_number().over(order))
    per_query = (
        with_ideal_rank(ranked).groupBy("query_id").agg(ndcg_column(k, "new_rank").alias("ndcg"))
    )
    return per_query.agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean_ndcg"))


def compare_orders(reranked: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """Per query: nDCG, MRR and recall of the dense and of the reranked order, and the nDCG delta.

    ``reranked`` holds both orders side by side (``rank`` and ``rerank_rank``), so one shuffle by
    query serves all six metrics.
    """
    counts = relevant_counts(relevance)
    return (
        with_ideal_rank(reranked)
        .groupBy("query_id")
        .agg(
            ndcg_column(k, "rank").alias("dense_ndcg"),
            ndcg_column(k, "rerank_rank").alias("reranked_ndcg"),
            mrr_column("rank").alias("dense_mrr"),
            mrr_column("rerank_rank").alias("reranked_mrr"),
            recalled_docs_column(k, "rank").alias("_dense_found"),
            recalled_docs_column(k, "rerank_rank").alias("_reranked_found"),
        )
        .join(counts, "query_id", "left")
        .withColumn("dense_recall", recall_ratio(F.col("_dense_found"), F.col("n_relevant")))
        .withColumn("reranked_recall", recall_ratio(F.col("_reranked_found"), F.col("n_relevant")))
        .withColumn("delta", F.col("reranked_ndcg") - F.col("dense_ndcg"))
        .drop("_dense_found", "_reranked_found", "n_relevant")
    )


def uplift_columns(tolerance: float = UPLIFT_TOLERANCE) -> list[Column]:
    up = F.count_if(F.col("delta") > tolerance)
    down = F.count_if(F.col("delta") < -tolerance)
    return [
        up.alias("n_improved"),
        down.alias("n_regressed"),
        (F.count(F.lit(1)) - up - down).alias("n_tied"),
    ]


def uplift_summary(per_query: DataFrame, tolerance: float = UPLIFT_TOLERANCE) -> DataFrame:
    return per_query.agg(*uplift_columns(tolerance))


def uplift_extremes(per_query: DataFrame) -> DataFrame:
    """The worst regression and the best gain, NULL where nothing moved that way.

    Among equal deltas the first query in ``seq`` order is the worst, the last one the best.
    """
    key = F.struct("delta", "seq")
    worst, best = F.min_by(F.struct("query", "delta"), key), F.max_by(F.struct("query", "delta"), key)
    both = per_query.agg(worst.alias("worst"), best.alias("best"))
    regressed, gained = F.col("worst.delta") < 0, F.col("best.delta") > 0
    return both.select(
        F.when(regressed, F.col("worst.query")).alias("worst_query"),
        F.when(regressed, F.col("worst.delta")).alias("worst_delta"),
        F.when(gained, F.col("best.query")).alias("best_query"),
        F.when(gained, F.col("best.delta")).alias("best_delta"),
    )


MEANS = ("dense_ndcg", "reranked_ndcg", "dense_mrr", "reranked_mrr", "dense_recall", "reranked_recall")


def ranking_summary(per_query: DataFrame) -> DataFrame:
    """One row: six means and the uplift counts. Means over no queries are an error, not NaN."""
    checked = F.when(
        F.count(F.lit(1)) == 0, F.raise_error(F.lit("no labelled query has candidates"))
    ).otherwise(F.count(F.lit(1)))
    return per_query.agg(
        *[F.avg(m).alias(m) for m in MEANS], *uplift_columns(), checked.alias("n_queries")
    )


def confusion(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predicted.groupBy(
        F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def f1_per_class(confused: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``class, support, hits, f1`` for every class seen as label or prediction, in each group of ``by``.

    An undefined F1 cannot occur for a class that was seen; a class never predicted right has 0.
    """
    sides = confused.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.lit(True).alias("truth")),
                F.struct(F.col("prediction").alias("class"), F.lit(False).alias("truth")),
            )
        ).alias("side"),
        (F.col("label") == F.col("prediction")).alias("right"),
        "n",
    )
    truth = F.col("side.truth")
    counts = sides.groupBy(*by, F.col("side.class").alias("class")).agg(
        F.sum(F.when(truth, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(truth & F.col("right"), F.col("n")).otherwise(0)).alias("hits"),
        F.sum("n").alias("both"),
    )
    return counts.withColumn("f1", F.lit(2.0) * F.col("hits") / F.col("both"))


def f1_report(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row ``macro_f1, accuracy, per_class_f1, n_test``.

    The macro mean runs over classes seen as label or prediction; ``per_class_f1`` lists the true
    labels in alphabetical order. Only the confusion counts, not the rows, reach the final task.
    """
    classes = f1_per_class(confusion(predicted, label, prediction))
    entry = F.when(F.col("support") > 0, F.struct("class", "f1"))
    return classes.agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum("hits").cast("double") / F.nullif(F.sum("support"), F.lit(0))).alias("accuracy"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_class_f1"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("n_test"),
    )
