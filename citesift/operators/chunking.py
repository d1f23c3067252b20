"""Documents to overlapping chunks with stable ids: one projection and one explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.functions.text import chunk_id, word_windows

CHUNK_SIZE = 200
CHUNK_OVERLAP = 40


def chunk_documents(
    documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """``chunk_id, doc_id, source, chunk_index, text``; the index restarts per document."""
    pieces = documents.select(
        "doc_id", "source", F.explode(word_windows(F.col("text"), size, overlap)).alias("piece")
    )
    return pieces.select(
        chunk_id(F.col("doc_id"), F.col("piece.chunk_index"), F.col("piece.text")).alias("chunk_id"),
        "doc_id",
        "source",
        F.col("piece.chunk_index").alias("chunk_index"),
        F.col("piece.text").alias("text"),
    )


def replicate_chunks(chunks: DataFrame, numbered: DataFrame, n_base: int, target: int) -> DataFrame:
    """``target`` rows that cycle through the base chunks: copy i repeats base row ``i % n_base``.

    ``numbered`` holds ``chunk_id, position`` with positions 1..n_base. Every base row lists its
    own copy numbers, so nothing is joined but the position.
    """
    first = F.col("position") - 1
    copies = F.when(first < target, F.sequence(first, F.lit(target - 1), F.lit(n_base).cast("bigint")))
    return (
        chunks.join(numbered.select("chunk_id", "position"), "chunk_id")
        .withColumn("copy", F.explode(copies))
        .select(
            F.concat(F.lit("bench-"), F.col("copy").cast("string")).alias("chunk_id"),
            "doc_id",
            "source",
            "chunk_index",
            "text",
            "copy",
        )
    )
