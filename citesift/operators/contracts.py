"""Data contracts. Each check raises ``ValueError`` and says what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.functions.citations import id_survives_citation


def check_depths(retrieve_top_k: int, rerank_top_k: int) -> None:
    if not 1 <= rerank_top_k <= retrieve_top_k:
        raise ValueError(
            f"rerank_top_k ({rerank_top_k}) must lie in 1..retrieve_top_k ({retrieve_top_k})"
        )


def repeated_chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def chunk_id_counts(chunks: DataFrame) -> DataFrame:
    """One row ``n_rows, n_ids, n_broken_ids``; the ids are unique if the first two agree."""
    per_id = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_ids"),
        F.count_if(~id_survives_citation(F.col("chunk_id"))).alias("n_broken_ids"),
    )


def check_citable(chunks: DataFrame) -> None:
    broken = chunks.where(~id_survives_citation(F.col("chunk_id"))).select("chunk_id").take(3)
    if broken:
        raise ValueError(f"ids that a citation cannot carry: {[r.chunk_id for r in broken]}")


def index_stats(index: DataFrame) -> DataFrame:
    """One row: chunks, vectors and the range of dimensions."""
    dim = F.size("embedding")
    return index.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count("embedding").alias("n_vectors"),
        F.coalesce(F.min(dim), F.lit(0)).cast("bigint").alias("min_dim"),
        F.coalesce(F.max(dim), F.lit(0)).cast("bigint").alias("max_dim"),
    )


def check_index_facts(facts: dict[str, int], n_rows: int) -> None:
    if facts["n_chunks"] != n_rows:
        raise ValueError(f"the index holds {n_rows} chunks, but {facts['n_chunks']} were saved")
    if facts["n_chunks"] != facts["n_vectors"]:
        raise ValueError(f"{facts['n_chunks']} chunks but {facts['n_vectors']} vectors")
    if facts["min_dim"] != facts["max_dim"]:
        raise ValueError(f"vectors of {facts['min_dim']} to {facts['max_dim']} dimensions in one index")


def check_index(index: DataFrame) -> None:
    """Every chunk has one vector, all vectors have one dimension, ids are unique."""
    facts = index_stats(index).first().asDict()
    check_index_facts(facts, facts["n_chunks"])
    check_unique_ids(index)


def check_unique_ids(index: DataFrame) -> None:
    """For once after a build: it shuffles every id."""
    twice = repeated_chunk_ids(index).take(3)
    if twice:
        raise ValueError(f"repeated chunk ids: {[r.chunk_id for r in twice]}")


def align_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Join chunk rows and vectors that were computed apart, one to one on ``chunk_id``.

    A chunk without a vector, or a vector without a chunk, fails the job that reads the result.
    """
    found = vectors.select("chunk_id", "embedding", F.lit(True).alias("_vector"))
    both = chunks.withColumn("_chunk", F.lit(True)).join(found, "chunk_id", "full_outer")
    alone = F.col("_chunk").isNull() | F.col("_vector").isNull()
    message = F.concat(F.lit("no partner for chunk id "), F.coalesce("chunk_id", F.lit("NULL")))
    checked = F.when(alone, F.raise_error(message)).otherwise(F.lit(True))
    return both.where(checked).drop("_chunk", "_vector")


def check_aligned(chunks: DataFrame, vectors: DataFrame) -> None:
    """Both sides hold exactly the same ids, once each."""
    sides = chunks.select("chunk_id", F.lit(1).alias("c"), F.lit(0).alias("v")).unionByName(
        vectors.select("chunk_id", F.lit(0).alias("c"), F.lit(1).alias("v"))
    )
    per_id = sides.groupBy("chunk_id").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    bad = per_id.where((F.col("c") != 1) | (F.col("v") != 1)).take(3)
    if bad:
        raise ValueError(f"chunks and vectors do not match: {[r.chunk_id for r in bad]}")


def dangling_references(referenced: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids that labels refer to but the corpus does not hold."""
    return referenced.select(key).distinct().join(corpus.select(key), key, "left_anti")


def text_digest(text: str) -> Column:
    return F.sha2(F.col(text), 256).alias("text_digest")


def shared_texts(train: DataFrame, test: DataFrame, text: str = "query") -> DataFrame:
    """Texts on both sides of a split, as digests: whole texts are never shuffled."""
    return train.select(text_digest(text)).intersect(test.select(text_digest(text)))


def vocabulary_drift(labels: DataFrame, declared: list[str]) -> DataFrame:
    """``label, drift``: labels in use but not declared, and declared but not in use."""
    used = labels.select("label").distinct()
    names = F.array(*[F.lit(d) for d in declared])
    known = labels.sparkSession.range(1).select(F.explode(names).alias("label"))
    return (
        used.subtract(known)
        .withColumn("drift", F.lit("undeclared"))
        .unionByName(known.subtract(used).withColumn("drift", F.lit("unused")))
    )


def check_training_sets(
    train: DataFrame, test: DataFrame, references: DataFrame, corpus: DataFrame
) -> None:
    """Train and test queries are disjoint and every relevant document exists."""
    if not shared_texts(train, test).isEmpty():
        raise ValueError("train and test queries overlap")
    missing = dangling_references(references, corpus).take(3)
    if missing:
        raise ValueError(f"labels name documents that do not exist: {[r.doc_id for r in missing]}")


def check_vocabulary(labels: DataFrame, declared: list[str]) -> None:
    drift = vocabulary_drift(labels, declared).take(5)
    if drift:
        raise ValueError(f"label vocabulary differs: {[tuple(r) for r in drift]}")
