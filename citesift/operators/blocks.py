"""Exact search over an index kept in blocks, most of which a search need not read.

A block holds the chunks nearest to one centre. Its summary bounds every score in it: with ``r`` the largest
distance to the centre ``c``, and ``a`` the largest angle between a chunk and the centre,

    q . x  <=  q . c + |q| r        and        q . x  <=  |q| |x| cos(max(0, angle(q, c) - a)).

Blocks are searched best bound first. The first wave takes, for each query, the best blocks that hold k chunks
together; its k-th score is a floor that the true k-th score cannot fall below. A second wave takes the blocks
whose bound reaches the floor. All others are proven out: their files are not read at all, as the block is a
partition of the table. Inside a task the floor keeps rising, and blocks are checked against it again.

The index lies where it is in both waves: no vector of it is shuffled, however many queries there are. Queries are taken
in blocks whose matrix fits ``BROADCAST_BYTES``; each reads the blocks that it needs.

How much is skipped depends on the data. Vectors without structure have wide blocks, and all of them are read; the
result is the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.functions.text import path_order
from citesift.operators.topk import BROADCAST_BYTES, LOCAL_HITS, _best, _block_search, dense_topk
from citesift.session import work_dir, write_and_read

BLOCK_ROWS = 1_024
FILE_ROWS = 1 << 18
MAX_BLOCKS = 1_024
SAMPLE_ROWS = 20_000
ROUNDS = 8
NEAREST_ROWS = 1_024
# Scores are single precision; bounds are raised by this share of their size.
SLACK = 1e-6

SUMMARY = "block int, centre array<double>, n_rows long, distance double, cosine double, shortest double, longest double"
PLACED = "struct<block:int,distance:double,cosine:double,norm:double>"
BLOCK_HITS = f"{LOCAL_HITS}, block int"


@dataclass(frozen=True)
class BlockedIndex:
    """``rows``: the index with a partition column ``block``; ``summary``: one row per block (``SUMMARY``)."""

    rows: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Bounds:
    """The summaries of all blocks as arrays; at most ``MAX_BLOCKS`` rows."""

    blocks: np.ndarray
    centres: np.ndarray
    n_rows: np.ndarray
    distance: np.ndarray
    cosine: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray

    @classmethod
    def read(cls, summary: DataFrame) -> Bounds:
        found = sorted(summary.collect(), key=lambda r: r["block"])
        columns = ["block", "centre", "n_rows", "distance", "cosine", "shortest", "longest"]
        return cls(*[np.array([r[c] for r in found]) for c in columns])

    def upper(self, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The most that a chunk of each block ``at`` can score, per query."""
        centres = self.centres[at]
        dots = queries @ centres.T
        size = np.linalg.norm(queries, axis=1)[:, None]
        ball = dots + size * self.distance[at]
        scale = size * np.linalg.norm(centres, axis=1)
        cosine = np.divide(dots, scale, out=np.ones_like(dots), where=scale > 0)
        angle = np.arccos(np.clip(cosine, -1, 1)) - np.arccos(np.clip(self.cosine[at], -1, 1)) - 1e-7
        across = np.cos(np.maximum(0, angle))
        cone = size * across * np.where(across > 0, self.longest[at], self.shortest[at])
        return np.minimum(ball, cone) + SLACK * (size * self.longest[at] + 1)


# ------------------------------------------------------------------ building


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """A nearest centre of each vector, in single precision: of nearly equal ones any is as good."""
    half, across = (centres**2).sum(axis=1).astype(np.float32) / 2, centres.T.astype(np.float32)
    of = np.empty(len(vectors), np.int64)
    for lo in range(0, len(vectors), NEAREST_ROWS):
        part = slice(lo, lo + NEAREST_ROWS)
        of[part] = np.argmax(vectors[part].astype(np.float32) @ across - half, axis=1)
    return of


def fit_centres(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means on a sample; centres start far from each other and empty ones are left where they are."""
    if not len(sample):
        return sample
    sample = np.unique(sample, axis=0)
    pick = np.random.default_rng(7)
    n = min(n, len(sample))
    centres = sample[pick.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        of = nearest(sample, centres)
        order = np.argsort(of, kind="stable")
        used, first = np.unique(of[order], return_index=True)
        centres[used] = np.add.reduceat(sample[order], first, axis=0) / np.diff(first, append=len(of))[:, None]
    return centres


def sample_vectors(index: DataFrame, n_rows: int, wanted: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``wanted`` vectors, drawn by the hash of the chunk."""
    rows = index.select("chunk_id", "embedding")
    if n_rows > wanted:
        grain = 1 << 30
        rows = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(grain)) < int(wanted / n_rows * grain)).limit(wanted)
    return matrix(rows.select("embedding").toArrow()["embedding"])


def placed_rows(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """The index with ``block``, and each chunk's distance and cosine to its centre and length."""
    shared = index.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centres = shared.value
        for column in batches:
            vectors = matrix(column)
            of = nearest(vectors, centres) if len(vectors) else np.empty(0, np.int64)
            own = centres[of] if len(vectors) else vectors
            norm = np.linalg.norm(vectors, axis=1)
            scale = norm * np.linalg.norm(own, axis=1)
            dots = (vectors * own).sum(axis=1)
            # Without a direction there is no angle: the widest cone.
            cosine = np.divide(dots, scale, out=np.full(len(vectors), -1.0), where=scale > 0)
            values = [of.astype(np.int32), np.linalg.norm(vectors - own, axis=1), cosine, norm]
            yield pa.StructArray.from_arrays([pa.array(v) for v in values], ["block", "distance", "cosine", "norm"])

    found = F.arrow_udf(place, PLACED).asNondeterministic()("embedding")
    return index.withColumn("found", found).select(*index.columns, "found.*")


def summarised(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``SUMMARY`` of written rows; only three numbers a row are read."""
    named = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "block int, centre array<double>")
    found = rows.groupBy("block").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("distance").alias("distance"),
        F.min("cosine").alias("cosine"),
        F.min("norm").alias("shortest"),
        F.max("norm").alias("longest"),
    )
    return found.join(F.broadcast(named), "block").select("block", "centre", "n_rows", "distance", "cosine", "shortest", "longest")


# ------------------------------------------------------------------ searching


@dataclass(frozen=True)
class Waves:
    """Which queries (by place) meet which block, first and then; ``skipped`` blocks are never read."""

    first: dict[int, np.ndarray]
    then: dict[int, np.ndarray]

    def skipped(self, bounds: Bounds) -> list[int]:
        return sorted(set(bounds.blocks.tolist()) - set(self.first) - set(self.then))


def first_wave(upper: np.ndarray, bounds: Bounds, k: int) -> np.ndarray:
    """Per query, True for the best blocks that hold k chunks together."""
    order = np.argsort(-upper, axis=1, kind="stable")
    before = np.cumsum(bounds.n_rows[order], axis=1) - bounds.n_rows[order]
    chosen = np.zeros(upper.shape, bool)
    np.put_along_axis(chosen, order, before < k, axis=1)
    return chosen


def _per_block(chosen: np.ndarray, bounds: Bounds) -> dict[int, np.ndarray]:
    return {int(bounds.blocks[b]): np.flatnonzero(chosen[:, b]) for b in np.flatnonzero(chosen.any(axis=0))}


def _scan(index: BlockedIndex, block: pa.Table, wave: dict[int, np.ndarray], bounds: Bounds, k: int) -> DataFrame:
    """The hits of a wave: only the wave's partitions are listed and read."""
    rows = index.rows.where(F.col("block").isin(sorted(wave))).select(
        "chunk_id", "doc_id", path_order(F.col("doc_id")).alias("path_order"), "chunk_index", "embedding", "block"
    )
    shared = index.rows.sparkSession.sparkContext.broadcast((block, wave, bounds))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wave, bounds = shared.value
        q = matrix(asked.column("embedding"))
        place = {int(b): i for i, b in enumerate(bounds.blocks)}
        last: dict[int, np.ndarray] = {}

        def choose(b: int, floor: np.ndarray) -> np.ndarray:
            if b not in last:
                last.clear()
                met = wave[b]
                last[b] = bounds.upper(q[met], np.array([place[b]]))[:, 0]
            return wave[b][last[b] >= floor[wave[b]]]

        yield from _block_search(k, choose)(batches, asked)

    return rows.mapInArrow(scan, BLOCK_HITS)


def search_block(queries: DataFrame, index: BlockedIndex, bounds: Bounds, k: int) -> tuple[DataFrame, Waves]:
    """Hits (``LOCAL_HITS``) of queries that fit a task, and the waves that found them."""
    block = queries.select("query_id", "embedding").toArrow()
    q, every = matrix(block.column("embedding")), np.arange(len(bounds.blocks))
    if len(q) and len(every) and q.shape[1] != bounds.centres.shape[1]:
        raise ValueError(f"index has {bounds.centres.shape[1]} dimensions, queries {q.shape[1]}")
    if not len(q) or not len(every):
        return queries.sparkSession.createDataFrame([], BLOCK_HITS), Waves({}, {})

    def with_floor(floor: np.ndarray) -> pa.Table:
        return block.append_column("floor", pa.array(floor, pa.float64()))

    upper = bounds.upper(q, every)
    chosen = first_wave(upper, bounds, k)
    first = _per_block(chosen, bounds)
    spark = queries.sparkSession
    found = _best(_scan(index, with_floor(np.full(len(q), -np.inf)), first, bounds, k), k)
    found = write_and_read(found, f"{work_dir(spark)}/first-wave/{uuid.uuid4().hex}")
    reached = {r["query_id"]: r["score"] for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}
    floor = np.array([reached.get(i, -np.inf) for i in block.column("query_id").to_pylist()])
    then = _per_block(~chosen & (upper >= floor[:, None]), bounds)
    hits = found.drop("rank")
    if then:
        hits = hits.unionByName(_scan(index, with_floor(floor), then, bounds, k))
    return hits, Waves(first, then)


def blocked_topk(queries: DataFrame, index: BlockedIndex, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """As ``dense_topk``, over an index in blocks; the rows also carry the ``block`` of the chunk."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    n, dim = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    bounds = Bounds.read(index.summary)
    at_once = max(1, broadcast_bytes // ((dim + 8) * 8))
    n_blocks = max(1, -(-n // at_once))
    if n_blocks == 1:
        hits, _ = search_block(queries, index, bounds, k)
    else:
        spark, place = queries.sparkSession, f"{work_dir(queries.sparkSession)}/blocked-hits/{uuid.uuid4().hex}"
        of = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
        for i in range(n_blocks):
            part, _ = search_block(queries.where(of == i), index, bounds, k)
            _best(part, k).drop("rank").write.mode("append").parquet(place)
        hits = spark.read.schema(BLOCK_HITS).parquet(place)
    return _best(hits, k).select("query_id", "rank", "score", "chunk_id", "doc_id", "chunk_index", "block")


def topk(queries: DataFrame, index: DataFrame | BlockedIndex, k: int, pilot_fraction: float | None = None) -> DataFrame:
    """The k best chunks per query, by the form that fits the index."""
    if isinstance(index, BlockedIndex):
        return blocked_topk(queries, index, k)
    return dense_topk(queries, index, k, pilot_fraction=pilot_fraction)
