"""Ingest: documents to a saved, searchable index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from citesift.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents
from citesift.operators.contracts import check_citable, check_unique_ids
from citesift.operators.embedding import Encoder, IdfEncoder, embed_chunks
from citesift.operators.features import corpus_stats
from citesift.session import write_and_read
from citesift.sources.corpus import read_text_corpus
from citesift.sources.encoders import save_encoder
from citesift.sources.eventlog import log_event
from citesift.sources.index_store import read_index, write_index


def index_documents(
    documents: DataFrame,
    encoder: Encoder,
    index_path: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    events_path: str | None = None,
) -> DataFrame:
    """Chunk, embed, save and reopen. Ids are deterministic, so re-runs are safe.

    Scan to write is one pass without a shuffle; the full contract is checked once, on what was
    written. An encoder with corpus weights is fitted by a pass before, unless it is fitted, and
    saved next to the index.
    """
    chunks = chunk_documents(documents, size, overlap)
    saved = None
    if isinstance(encoder, IdfEncoder):
        encoder = encoder if encoder.rarity is not None else encoder.fit(chunks)
        saved = save_encoder(documents.sparkSession, encoder, index_path)
    write_index(embed_chunks(chunks, encoder), index_path, saved)
    index = read_index(documents.sparkSession, index_path)
    check_unique_ids(index)
    check_citable(index)
    if events_path:
        log_event(
            documents.sparkSession,
            events_path,
            "ingest",
            "index_built",
            n_chunks=index.count(),
            index_path=index_path,
        )
    return index


def build_corpus_index(
    spark: SparkSession, corpus_path: str, encoder: Encoder, index_path: str, **options: object
) -> DataFrame:
    return index_documents(read_text_corpus(spark, corpus_path), encoder, index_path, **options)


def saved_stats(index: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Corpus statistics of an index as written tables, computed once per index.

    Written ones are only read, if they count as many chunks as the index holds; a running reader
    never sees them replaced otherwise.
    """
    spark = index.sparkSession
    frequency, size = corpus_stats(index)
    try:
        written = spark.read.schema(size.schema).parquet(f"{path}/size")
        row = written.first()
        if row is not None and row["n_chunks"] == index.count():
            return spark.read.schema(frequency.schema).parquet(f"{path}/frequency"), written
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    # The size is written last: it marks the statistics as complete.
    frequency = write_and_read(frequency, f"{path}/frequency")
    return frequency, write_and_read(size, f"{path}/size")
