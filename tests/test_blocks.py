"""The index in blocks: bounds, skipped blocks, equality with brute force, lookups that prune."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citesift.operators import blocks
from citesift.operators.blocks import Bounds, blocked_topk, search_block
from citesift.operators.topk import attach_passages
from citesift.sources.block_store import read_blocked_index, write_blocked_index

INDEX = "chunk_id string, doc_id string, source string, chunk_index int, text string, embedding array<float>"
ASKED = "query_id string, embedding array<float>"


def clustered(n, dim, groups, spread=0.05, unit=True):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = centres[np.arange(n) % groups] + spread * rng.standard_normal((n, dim))
    if unit:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v.astype(np.float32)


def index_of(rows, vectors):
    return rows([(f"c{i}", f"d{i:05d}", "s", 0, f"text {i}", v.tolist()) for i, v in enumerate(vectors)], INDEX)


def asked_of(rows, queries):
    return rows([(str(i), v.tolist()) for i, v in enumerate(queries)], ASKED)


def brute_force(queries, vectors, k):
    scores = (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.float32)
    return {
        str(i): [(f"c{j}", float(s[j])) for j in sorted(range(len(vectors)), key=lambda j: (-s[j], j))[:k]]
        for i, s in enumerate(scores)
    }


def found_by(hits):
    found = {}
    for r in hits.orderBy("rank").collect():
        found.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return found


def test_bounds_are_never_below_a_score():
    rng = np.random.default_rng(1)
    for unit in (True, False):
        v = clustered(400, 6, 8, 0.4, unit).astype(np.float64)
        v[5] = 0
        centres = blocks.fit_centres(v, 8)
        of = blocks.nearest(v, centres)
        own = [v[of == c] for c in range(len(centres))]

        def cosines(rows, c):
            scale = np.linalg.norm(rows, axis=1) * np.linalg.norm(c)
            return np.divide(rows @ c, scale, out=np.full(len(rows), -1.0), where=scale > 0)

        bounds = Bounds(
            np.arange(len(centres)),
            centres,
            np.array([len(o) for o in own]),
            np.array([np.linalg.norm(o - c, axis=1).max() for o, c in zip(own, centres)]),
            np.array([cosines(o, c).min() for o, c in zip(own, centres)]),
            *[np.array([f(np.linalg.norm(o, axis=1)) for o in own]) for f in (np.min, np.max)],
        )
        q = np.vstack([rng.standard_normal((40, 6)) * 3, v[:20], -v[:20], np.zeros((1, 6))])
        upper = bounds.upper(q, np.arange(len(centres)))
        for b, o in enumerate(own):
            assert (upper[:, b] >= (q @ o.T).max(axis=1)).all()


@pytest.mark.parametrize("k", [1, 7, 500])
@pytest.mark.parametrize("unit", [True, False])
def test_search_equals_brute_force_with_many_copies(rows, tmp_path, k, unit):
    vectors = clustered(240, 8, 6, 0.2, unit)
    vectors = np.vstack([vectors, np.repeat(vectors[:1], 120, axis=0), np.zeros((2, 8), np.float32)])
    queries = np.vstack([vectors[:6], -vectors[:3], np.zeros((1, 8), np.float32)])
    index = write_blocked_index(index_of(rows, vectors).repartition(3), str(tmp_path / "index"), block_rows=30)
    assert index.summary.count() > 4
    expected = brute_force(queries, vectors, k)
    asked = asked_of(rows, queries)
    assert found_by(blocked_topk(asked, index, k)) == expected
    assert found_by(blocked_topk(asked, index, k, broadcast_bytes=3 * 16 * 8)) == expected


def test_blocks_are_skipped_and_their_files_are_not_read(rows, tmp_path):
    vectors = clustered(600, 16, 12)
    index = write_blocked_index(index_of(rows, vectors), str(tmp_path / "index"), block_rows=50)
    queries, bounds = vectors[:2], Bounds.read(index.summary)
    hits, waves = search_block(asked_of(rows, queries), index, bounds, 5)
    assert len(waves.skipped(bounds)) >= len(bounds.blocks) // 2
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert not waves.then or re.search(r"PartitionFilters: \[[^\]]*block", plan)
    assert found_by(blocked_topk(asked_of(rows, queries), index, 5)) == brute_force(queries, vectors, 5)


def test_no_vector_is_shuffled_at_any_number_of_queries(rows, tmp_path):
    vectors = clustered(90, 4, 3)
    index = write_blocked_index(index_of(rows, vectors), str(tmp_path / "index"), block_rows=30)
    for options in ({}, {"broadcast_bytes": 0}):
        plan = blocked_topk(asked_of(rows, vectors[:9]), index, 2, **options)._jdf.queryExecution().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert exchanges and not any("embedding" in line for line in exchanges)


def test_passages_are_read_from_the_blocks_of_the_hits(spark, rows, tmp_path):
    vectors = clustered(300, 8, 10)
    index = write_blocked_index(index_of(rows, vectors), str(tmp_path / "index"), block_rows=30)
    hits = blocked_topk(asked_of(rows, vectors[:2]), index, 3)
    passages = attach_passages(hits, index.rows, 6)
    assert {(r.chunk_id, r.text) for r in passages.collect()} == {
        (c, f"text {c[1:]}") for found in brute_force(vectors[:2], vectors, 3).values() for c, _ in found
    }
    assert "dynamicpruning" in passages._jdf.queryExecution().executedPlan().toString()
    assert "block" not in passages.columns
    shuffled = attach_passages(hits, index.rows, None)
    assert sorted(shuffled.select(passages.columns).collect()) == sorted(passages.collect())


def test_a_hot_block_is_written_by_several_tasks(monkeypatch, rows, tmp_path):
    from citesift.sources import block_store

    monkeypatch.setattr(block_store, "FILE_ROWS", 20)
    vectors = np.repeat(clustered(1, 4, 1), 100, axis=0)
    index = write_blocked_index(index_of(rows, vectors), str(tmp_path / "index"), block_rows=1000)
    assert index.rows.where(F.col("block") == 0).count() == 100 and len(index.rows.inputFiles()) > 1


def test_edges(spark, rows, tmp_path):
    vectors = clustered(20, 4, 2)
    path = str(tmp_path / "index")
    index = write_blocked_index(index_of(rows, vectors), path)
    assert blocked_topk(rows([], ASKED), index, 3).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        blocked_topk(asked_of(rows, vectors[:1]), index, 0)
    with pytest.raises(ValueError, match="dimensions"):
        blocked_topk(rows([("q", [1.0])], ASKED), index, 1)
    with pytest.raises(ValueError, match="no complete index"):
        read_blocked_index(spark, str(tmp_path / "nothing"))
    index.rows.limit(3).drop("block").write.mode("append").parquet(f"{path}/block=0")
    with pytest.raises(ValueError):
        read_blocked_index(spark, path)


def test_an_empty_index_has_no_hits(rows, tmp_path):
    index = write_blocked_index(rows([], INDEX), str(tmp_path / "index"))
    assert blocked_topk(asked_of(rows, clustered(2, 4, 1)), index, 3).count() == 0


def test_a_stored_index_is_placed_once_and_not_written_again(spark, rows, tmp_path, monkeypatch):
    from citesift.sources import block_store

    vectors = clustered(80, 4, 3)
    index_of(rows, vectors).write.parquet(str(tmp_path / "plain"))
    written = []
    monkeypatch.setattr(block_store, "write_and_read", lambda df, path: written.append(path))
    index = write_blocked_index(spark.read.parquet(str(tmp_path / "plain")), str(tmp_path / "index"), 30, stored=True)
    assert not written
    assert found_by(blocked_topk(asked_of(rows, vectors[:4]), index, 5)) == brute_force(vectors[:4], vectors, 5)
