"""Exact top-k by inner product, for all queries at once.

No (query, chunk) pair ever becomes a row. Chunk vectors meet a block of queries inside a task as
one matrix product; what leaves the task is at most k hits per query. Two ways lead there:

* few queries (their matrix fits ``BROADCAST_BYTES``, checked first): the matrix is broadcast and
  the index is scanned where it lies, without shuffling a single chunk vector;
* more queries: both sides are cut by hash into blocks of bounded size and every pair of blocks is
  cogrouped. The work is that of the exact search itself; each task holds two blocks.

The local hits are then ranked by a window, for which Spark keeps only the k best rows per query
before the shuffle (WindowGroupLimit). Every task may send k hits per query, so on an index of many
thousand splits ``pilot_fraction`` first searches a sample with one task per core: the sample's
k-th score per query is a lower bound on the true one, and the full pass sends nothing below it.
The result stays exact; only the number of hits sent changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesift.functions.text import path_order

BROADCAST_BYTES = 16 * 1024 * 1024
BROADCAST_HITS = 200_000
QUERY_BLOCK = 2_048
CHUNK_BLOCK = 16_384

LOCAL_HITS = (
    "query_id string, score double, chunk_id string, doc_id string, path_order string, chunk_index int"
)


def dense_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    *,
    pilot_fraction: float | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    query_block: int = QUERY_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """``query_id, rank, score, chunk_id, doc_id, chunk_index`` for the k best chunks per query.

    ``queries`` has ``query_id, embedding``; ``index`` has ``chunk_id, doc_id, chunk_index,
    embedding``. Scores are single precision; ties go to corpus order (path, then chunk index). If
    k exceeds the corpus, every chunk is returned once.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    index = index.select(
        "chunk_id", "doc_id", path_order(F.col("doc_id")).alias("path_order"), "chunk_index", "embedding"
    )
    if pilot_fraction:
        cores = index.sparkSession.sparkContext.defaultParallelism
        sample = index.sample(fraction=pilot_fraction, seed=7).coalesce(cores)
        pilot = _local_hits(queries, sample, k, broadcast_bytes, query_block, chunk_block)
        floors = (
            _best(pilot, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        )
        queries = queries.join(floors, "query_id", "left")
    hits = _local_hits(queries, index, k, broadcast_bytes, query_block, chunk_block)
    return _best(hits, k).select("query_id", "rank", "score", "chunk_id", "doc_id", "chunk_index")


def attach_passages(hits: DataFrame, index: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Fetch source and text for the hits only: the search itself carries ids and scores.

    ``max_hits`` is a proven bound on the rows of ``hits`` (queries times k). Up to
    ``BROADCAST_HITS`` the hits go to the index, whose text is then never shuffled; beyond that it
    is a shuffle join, where Spark's runtime Bloom filter drops chunks that nobody hit. Hits that carry the ``block``
    of an index partitioned by it read only the partitions they name, which Spark finds at run time.
    """
    by = ["block", "chunk_id"] if "block" in hits.columns and "block" in index.columns else ["chunk_id"]
    texts = index.select(*by, "source", "text")
    if max_hits is not None and max_hits <= BROADCAST_HITS:
        return texts.join(F.broadcast(hits), by).drop("block")
    return hits.join(texts, by).drop("block")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path_order", "chunk_index")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _local_hits(
    queries: DataFrame, index: DataFrame, k: int, broadcast_bytes: int, query_block: int, chunk_block: int
) -> DataFrame:
    if "floor" not in queries.columns:
        queries = queries.withColumn("floor", F.lit(None).cast("double"))
    search = _block_search(k)
    shape = queries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")
    ).first()

    if shape["n"] * (shape["dim"] + 8) * 8 <= broadcast_bytes:
        block = queries.select("query_id", "embedding", "floor").toArrow()
        shared = index.sparkSession.sparkContext.broadcast(block)

        def scan(batches):
            yield from search(batches, shared.value)

        return index.mapInArrow(scan, LOCAL_HITS)

    n_query_blocks = -(-shape["n"] // query_block)
    n_chunk_blocks = max(1, -(-index.count() // chunk_block))

    def block_of(column: str, blocks: int):
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def all_blocks(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = index.withColumn("_c", block_of("chunk_id", n_chunk_blocks)).withColumn(
        "_q", all_blocks(n_query_blocks)
    )
    right = queries.withColumn("_q", block_of("query_id", n_query_blocks)).withColumn(
        "_c", all_blocks(n_chunk_blocks)
    )

    def pair(chunk_block, query_block):
        import pyarrow as pa

        found = list(search(chunk_block.to_batches(), query_block))
        if found:
            return pa.Table.from_batches(found)
        fields = [("query_id", "s"), ("score", "d"), ("chunk_id", "s"), ("doc_id", "s"), ("path_order", "s")]
        kinds = {"s": pa.string(), "d": pa.float64()}
        columns = {name: pa.array([], kinds[kind]) for name, kind in fields}
        return pa.table({**columns, "chunk_index": pa.array([], pa.int32())})

    return left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(pair, LOCAL_HITS)


def _block_search(k: int, choose=None):
    """Task-side helper: stream chunk batches past one block of queries, keep k hits per query.

    With ``choose``, batches have a column ``block``, and rows of a block meet only the queries at the places that
    ``choose(block, floor)`` names, given the scores that a hit must reach so far.

    All pairs are multiplied in single precision; only those that may reach the floor of their query, given the
    largest error of that product, are scored again in double precision. Scores and hits are those of the latter.
    """
    chunk_rows, query_rows, buffer_rows, tracked_scores, pair_rows = 2_048, 512, 500_000, 16_000_000, 8_192
    carried = ["chunk_id", "doc_id", "path_order", "chunk_index"] + (["block"] if choose else [])

    def search(batches, query_block):
        import numpy as np
        import pyarrow as pa

        def matrix(column):
            flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            values = flat.flatten().to_numpy(zero_copy_only=False)
            return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))

        query_ids = query_block.column("query_id").to_numpy()
        q = matrix(query_block.column("embedding")).astype(np.float64)
        floor = query_block.column("floor").to_numpy().astype(np.float64)
        floor = np.where(np.isnan(floor), -np.inf, floor)
        if not len(query_ids):
            return
        with np.errstate(over="ignore"):
            single = q.astype(np.float32)
        size = np.linalg.norm(q, axis=1)
        products, may = np.empty(chunk_rows * query_rows, np.float32), np.empty(chunk_rows * query_rows, bool)
        # Rounding both sides, and adding up as many products, each to a half unit of the last place.
        unit = (q.shape[1] + 16) * 2.0**-23

        # The k best scores so far of each query; the lowest of them is what a later chunk must reach.
        # Not kept for a k so large that the table would weigh more than the hits it saves.
        tracked = len(q) * k <= tracked_scores
        best = np.full((len(q), k if tracked else 0), -np.inf, dtype=np.float32)

        def raise_floor(at, row, value):
            """``row`` rises and counts places in ``at``."""
            if not tracked or not len(row):
                return
            counts = np.bincount(row, minlength=len(at))
            with_hits = np.flatnonzero(counts)
            begins = np.cumsum(counts) - counts
            scores = np.full((len(with_hits), counts.max()), -np.inf, dtype=np.float32)
            scores[(np.cumsum(counts > 0) - 1)[row], np.arange(len(row)) - begins[row]] = value
            at = at[with_hits]
            merged = np.concatenate([best[at], scores], axis=1)
            best[at] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
            floor[at] = np.maximum(floor[at], best[at].min(axis=1))

        def pieces(batches):
            """Rows to search, and the places of the queries that they meet."""
            every = np.arange(len(q))
            for batch in batches:
                cuts = [0, batch.num_rows]
                if choose is not None:
                    block = batch.column("block").to_numpy(zero_copy_only=False)
                    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
                for begin, end in zip(cuts, cuts[1:]):
                    for start in range(begin, end, chunk_rows):
                        met = every if choose is None else choose(int(block[start]), floor)
                        if len(met):
                            yield batch.slice(start, min(chunk_rows, end - start)), met

        def exact(rows, vectors, row, col):
            """The scores of pairs of a query among ``rows`` and a vector, rounded to single precision."""
            if len(row) > len(rows) * len(vectors) // 16:
                return (q[rows] @ vectors.astype(np.float64).T)[row, col].astype(np.float32) + np.float32(0)
            found = np.empty(len(row), np.float32)
            for lo in range(0, len(row), pair_rows):
                part = slice(lo, lo + pair_rows)
                left, right = q[rows[row[part]]], vectors[col[part]].astype(np.float64)
                found[part] = np.einsum("ij,ij->i", left, right)
            return found + np.float32(0)

        def pairs(at, vectors, longest):
            """Pairs that can be among the k best of their query: places in ``at``, rows of ``vectors``, scores."""
            if not 1e-12 < size[at].max() * longest < 1e30:  # beyond the range where the error is bounded so
                scores = (q[at] @ vectors.astype(np.float64).T).astype(np.float32) + np.float32(0)
                row, col = np.nonzero(scores >= floor[at][:, None])
                return row, col, scores[row, col]
            n = len(at) * len(vectors)
            scores, near = products[:n].reshape(len(at), -1), may[:n].reshape(len(at), -1)
            np.matmul(single[at], vectors.astype(np.float32, copy=False).T, out=scores)
            error = size[at] * longest * unit + 1e-30
            np.greater_equal(scores, _below(floor[at] - error)[:, None], out=near)
            row, col = np.divmod(np.flatnonzero(may[:n]), len(vectors))
            many = np.flatnonzero(np.bincount(row, minlength=len(at)) > k)
            if len(many):  # the k-th of these few is a floor, too
                kth = np.partition(scores[many], len(vectors) - k, axis=1)[:, len(vectors) - k]
                least = np.full(len(at), -np.inf, np.float32)
                least[many] = _below(kth - 2 * error[many])
                good = scores[row, col] >= least[row]
                row, col = row[good], col[good]
            value = exact(at, vectors, row, col)
            good = value >= floor[at[row]]
            return row[good], col[good], value[good]

        def _below(x):
            """Single-precision numbers that are not above ``x``."""
            return np.nextafter(x.astype(np.float32), np.float32(-np.inf))

        def keep_best(ids, parts):
            """The hits that are left, and the rows of ``ids`` that they name."""
            of, score, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            good = score >= floor[of]
            of, score, (rows, row) = of[good], score[good], np.unique(row[good], return_inverse=True)
            ids = pa.Table.from_batches(ids).combine_chunks().take(pa.array(rows))
            order = ids.select(["path_order", "chunk_index"]).to_pandas().sort_values(["path_order", "chunk_index"])
            place = np.empty(len(rows), np.int64)
            place[order.index.to_numpy()] = np.arange(len(rows))
            order = np.lexsort((place[row], -score, of))
            of, score, row = of[order], score[order], row[order]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            kept = np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of))) < k
            return ids, (of[kept], score[kept], row[kept])

        ids, n_ids, parts, n_hits = [], 0, [], 0
        for piece, met in pieces(batches):
            vectors = matrix(piece.column("embedding"))
            if vectors.shape[1] != q.shape[1]:
                raise ValueError(f"index has {vectors.shape[1]} dimensions, queries {q.shape[1]}")
            longest = np.sqrt(np.nanmax((vectors.astype(np.float64) ** 2).sum(axis=1)))
            for lo in range(0, len(met), query_rows):
                at = met[lo : lo + query_rows]
                row, col, value = pairs(at, vectors, longest)
                if not len(row):
                    continue
                raise_floor(at, row, value)
                used, col = np.unique(col, return_inverse=True)
                ids.append(piece.select(carried).take(pa.array(used)))
                parts.append((at[row], value.astype(np.float64), col + n_ids))
                n_ids, n_hits = n_ids + len(used), n_hits + len(row)
                if n_hits > max(buffer_rows, 2 * k * len(q)):
                    table, hits = keep_best(ids, parts)
                    ids, n_ids, parts, n_hits = table.to_batches(), len(table), [hits], len(hits[0])
        if parts:
            table, (of, score, row) = keep_best(ids, parts)
            kinds = {"chunk_id": pa.string(), "doc_id": pa.string(), "path_order": pa.string()}
            numbers = {"chunk_index": pa.int32(), "block": pa.int32()}
            found = table.take(pa.array(row)).combine_chunks()
            columns = [pa.array(query_ids[of], pa.string()), pa.array(score, pa.float64())]
            for c in carried:
                column = found.column(c).cast({**kinds, **numbers}[c])
                columns.append(pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type))
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "score", *carried])

    return search
