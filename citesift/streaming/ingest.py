"""Document stream to index table: chunking and encoding are stateless and run on the stream itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from citesift.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents
from citesift.operators.embedding import Encoder
from citesift.sources.index_store import INDEX_SCHEMA, add_to_index


def stream_index(
    documents: DataFrame,
    encoder: Encoder,
    index_path: str,
    checkpoint: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    partitions: int = 0,
) -> StreamingQuery:
    """Append every new document's chunks; the file sink commits each batch exactly once.

    When a run has ended, ``record_facts`` makes the table an index that ``read_index`` opens.

    ``partitions`` spreads a source of few, large splits before the encoding.
    """
    if partitions:
        documents = documents.repartition(partitions)
    index = encoder.encode(chunk_documents(documents, size, overlap)).select(INDEX_SCHEMA.names)
    return (
        index.writeStream.format("parquet")
        .option("path", index_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_into_index(
    documents: DataFrame,
    encoder: Encoder,
    index_path: str,
    checkpoint: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    partitions: int = 0,
) -> StreamingQuery:
    """Add every new document's chunks to an index that ``read_index`` opens at any time.

    A batch is committed whole, files first and its row of the manifest last. A batch that is run again is
    added once: it is named by the query's id, which the checkpoint keeps, and its number.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        if partitions:
            batch = batch.repartition(partitions)
        stream_id = batch.sparkSession.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        add_to_index(encoder.encode(chunk_documents(batch, size, overlap)), index_path, f"{stream_id}-{batch_id}")

    return (
        documents.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
