"""Text to unit vectors. One encoder serves both corpus and queries, so their vectors match.

An encoder is any object with ``dim`` and ``encode(df, text_col, out_col) -> DataFrame``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.functions.text import lower_bytes, tokens_of
from citesift.functions.vectors import TokenBuckets, bucket_labels, token_buckets
from citesift.session import work_dir, write_and_read

HASH_DIM = 256


class Encoder(Protocol):
    dim: int

    def encode(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame: ...


class HashEncoder:
    """Offline encoder: token counts in ``dim`` hash buckets, scaled to length 1.

    The counting runs in Arrow batches; a task hashes a token once and remembers its bucket. Stateless, so it
    also runs on streams. A NULL text has no tokens and gets the zero vector, as an empty one.
    """

    def __init__(self, dim: int = HASH_DIM):
        self.dim = dim

    def _counting(self, text_col: str, finish: Callable[[np.ndarray], np.ndarray], kind: str) -> Column:
        """``finish`` of the counts of a batch, one row per text."""
        dim = self.dim

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            buckets = TokenBuckets(dim)
            for texts in batches:
                values = finish(buckets.counts(tokens_of(texts)))
                yield pa.ListArray.from_arrays(np.arange(0, values.size + 1, dim, dtype=np.int32), values.ravel())

        return F.arrow_udf(run, kind).asNondeterministic()(lower_bytes(F.coalesce(text_col, F.lit(""))))

    def counted(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``_counts``: the tokens of a text in each bucket."""
        counts = self._counting(text_col, lambda found: found, "array<double>")
        return df.withColumn("_counts", array_to_vector(counts))

    def encode(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        def unit(counts: np.ndarray) -> np.ndarray:
            length = np.sqrt((counts**2).sum(axis=1, keepdims=True))
            return (counts / np.where(length == 0, 1.0, length)).astype(np.float32)

        return df.withColumn(out_col, self._counting(text_col, unit, "array<float>"))


class IdfEncoder(HashEncoder):
    """Token counts in hash buckets, each times the rarity of its bucket in the corpus, scaled to length 1.

    The rarity is ``ln((1 + n) / (1 + df)) + 1``, where ``df`` of the ``n`` chunks have a token in the bucket;
    it is at least 1, so a text with tokens never gets the zero vector. ``fit`` learns it, one number per
    bucket. The fitted encoder is stateless: corpus, queries and streams all use the one fitted at ingest.
    """

    def __init__(self, dim: int = HASH_DIM, rarity: list[float] | None = None):
        super().__init__(dim)
        if rarity is not None and len(rarity) != dim:
            raise ValueError(f"{len(rarity)} weights for {dim} buckets")
        self.rarity = rarity

    def fit(self, chunks: DataFrame, text_col: str = "text") -> IdfEncoder:
        """One pass; what is shuffled and read is one count per bucket, and one of the chunks."""
        every = "all"  # no bucket is named so
        held = F.array_distinct(token_buckets(F.coalesce(text_col, F.lit("")), self.dim))
        names = chunks.select(F.explode(F.concat(held, F.array(F.lit(every)))).alias("name"))
        found = {r["name"]: r["count"] for r in names.groupBy("name").count().collect()}
        return self._of([found.get(b, 0) for b in bucket_labels(self.dim)], found.get(every, 0))

    def _of(self, held: list[int], n: int) -> IdfEncoder:
        return IdfEncoder(self.dim, [math.log((1 + n) / (1 + df)) + 1 for df in held])

    def fit_encode(self, chunks: DataFrame, text_col: str = "text", out_col: str = "embedding") -> tuple[IdfEncoder, DataFrame]:
        """``fit`` and the encoded chunks without their text, which is read and hashed once for both.

        The counts are written; fitting adds up one number per bucket in every task.
        """
        place = f"{work_dir(chunks.sparkSession)}/bucket-counts/{uuid.uuid4().hex}"
        counts = write_and_read(self.counted(chunks, text_col).drop(text_col), place)
        n, held = counts.count(), [0] * self.dim
        if n:  # there is no summary of no rows
            held = counts.select(Summarizer.numNonZeros(F.col("_counts"))).first()[0].toArray().astype(int).tolist()
        fitted = self._of(held, n)
        return fitted, fitted.scaled(counts, out_col)

    def encode(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        return self.scaled(self.counted(df, text_col), out_col)

    def scaled(self, counted: DataFrame, out_col: str = "embedding") -> DataFrame:
        """The vectors of ``counted`` rows."""
        unit = Normalizer(p=2.0, inputCol="_weights", outputCol="_unit")
        return (
            unit.transform(self.weighed(counted))
            .withColumn(out_col, vector_to_array("_unit", "float32"))
            .drop("_counts", "_weights", "_unit")
        )

    def weighed(self, counted: DataFrame) -> DataFrame:
        """``_weights`` from the token counts ``_counts``."""
        if self.rarity is None:
            raise ValueError("the encoder has no weights: fit it, or open the one saved with the index")
        weights = Vectors.dense(self.rarity)
        return ElementwiseProduct(scalingVec=weights, inputCol="_counts", outputCol="_weights").transform(counted)


class BatchEncoder:
    """Plug-in encoder: ``factory()`` builds a model that maps a list of texts to a float matrix.

    The model is built once per task, not per row or batch; rows reach it in Arrow batches of
    ``batch_rows``. Vectors are scaled to length 1 here. ``partitions`` spreads few large input
    splits over more tasks before the model pass.
    """

    def __init__(self, factory: Callable[[], Callable], dim: int, batch_rows: int = 32, partitions: int = 0):
        self.factory, self.dim, self.batch_rows, self.partitions = factory, dim, batch_rows, partitions

    def encode(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        factory, dim, step = self.factory, self.dim, self.batch_rows

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import numpy as np

            model = factory()
            for texts in batches:
                rows = []
                for start in range(0, len(texts), step):
                    part = list(texts.iloc[start : start + step])
                    vectors = np.asarray(model(part), dtype=np.float64)
                    if vectors.shape != (len(part), dim):
                        raise ValueError(f"encoder gave {vectors.shape}, expected {(len(part), dim)}")
                    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                    rows.extend((vectors / np.where(norms == 0, 1.0, norms)).astype(np.float32))
                yield pd.Series(rows)

        if self.partitions:
            df = df.repartition(self.partitions)
        return df.withColumn(out_col, run(F.col(text_col)))


def embed_chunks(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """Chunks plus ``embedding``. An empty corpus is an error; finding that out reads one row."""
    if chunks.isEmpty():
        raise ValueError("there are no chunks to embed")
    return encoder.encode(chunks)
