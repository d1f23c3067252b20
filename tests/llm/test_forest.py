import numpy as np
import pytest
from pyspark.sql import functions as F

from citesift.llm import forest

SCHEMA = "vec_id long, embedding array<float>"


def brute_force(data, k, every):
    """Nearest others of each query among usable rows, ties to the smaller id."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in data if i is not None and v and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    out = {}
    for i, v in ok:
        if i % every == 0:
            near = [(-forest.exact_cosines(v[None], w[None])[0], j) for j, w in ok if j != i]
            out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def run(rows, data, k=5, every=5, schema=SCHEMA):
    found = forest.nearest(rows(data, schema), F.col("vec_id") % every == 0, k).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_searched_exactly(rows):
    pick = np.random.default_rng(1)
    data = [(i, pick.normal(size=8).tolist()) for i in range(120)]
    assert run(rows, data) == brute_force(data, 5, 5)


def test_many_equal_vectors_tie_by_id(rows, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(forest, "QUERY_BLOCK", 3)
    pick = np.random.default_rng(2)
    data = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100)] + [(i, pick.normal(size=4).tolist()) for i in range(100, 130)]
    assert run(rows, data) == brute_force(data, 5, 5)


def test_unusable_rows_take_no_part(rows):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0])]
    data += [(None, [1.0, 0.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (10, [1.0, 1.0]), (11, [1.0])]
    clean = [d for d in data if d[0] != 11]
    clean = [d for i, d in enumerate(clean) if d not in clean[:i]]
    assert run(rows, data) == brute_force(clean, 5, 5)


def test_empty_and_single(rows):
    assert run(rows, []) == {}
    assert run(rows, [(0, [1.0, 2.0])]) == {}


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_against_brute_force(rows, monkeypatch, clustered):
    monkeypatch.setattr(forest, "MIN_ROWS", 50)
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(60, 16)) * 3
    data = []
    for i in range(3000):
        v = pick.normal(size=16) + (centres[i % 60] if clustered else 0)
        data.append((i, v.astype(np.float32).tolist()))
    monkeypatch.setattr(forest, "SHARE", 0.9)
    share = 0.15 if clustered else forest.SHARE
    found = forest.nearest(rows(data, SCHEMA), F.col("vec_id") % 50 == 0, 5, share=share).collect()
    expected = {(q, j) for q, near in brute_force(data, 5, 50).items() for j, _ in near}
    hits = {(r["query_id"], r["vec_id"]) for r in found}
    assert len(expected & hits) >= 0.9 * len(expected)


def test_shared_queue_takes_leaves_in_order_of_distance():
    pick = np.random.default_rng(4)
    sample = forest._unit(pick.normal(size=(500, 6)))
    trees = forest.grow(sample, 500, n_trees=3)
    leaf = trees.leaves(sample)
    sizes = np.stack([np.bincount(leaf[:, t], minlength=2**trees.depth) for t in range(3)])
    margin = trees.margins(sample[:1])[0]
    every = forest.search(trees, margin, sizes, np.inf)
    assert len(every) == len(set(every)) == (sizes > 0).sum()
    assert {(t, leaf[0, t]) for t in range(3)} <= set(every[:3])
    some = forest.search(trees, margin, sizes, 100)
    assert some == every[: len(some)]
