import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citesift.llm import neardup
from citesift.llm.components import connected


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(data):
    """Component of each document by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in data}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: root(i) for i in sets}


def corpus(seed):
    """Groups of edited copies of all sizes, a passage that many texts share, short texts."""
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = pick.choices(vocabulary, k=60)
    out = []
    for n in (2, 3, 5, 60):
        base = pick.choices(vocabulary, k=pick.choice([12, 40, 150]))
        for _ in range(n):
            copy = list(base)
            for _ in range(pick.randint(0, max(1, len(base) // 25))):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            out.append(copy)
    out += [pick.choices(vocabulary, k=50) + passage + pick.choices(vocabulary, k=50) for _ in range(40)]
    out += [pick.choices(vocabulary, k=pick.randint(1, 9)) for _ in range(40)]
    pick.shuffle(out)
    return [(i, " ".join(words)) for i, words in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(docs, seed):
    data = corpus(seed)
    found = {r["doc_id"]: r for r in neardup.near_duplicates(docs(data)).collect()}
    expected = brute_force(data)
    assert {i: r["component_id"] for i, r in found.items()} == expected
    for i, text in data:
        assert found[i]["n_shingles"] == len(shingles(text))
        assert found[i]["kept"] == (expected[i] == i)


def test_edge_rows(docs):
    long = " ".join(f"x{i}" for i in range(60_000))
    data = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "Één"), (7, "één")]
    data += [(8, long), (9, long + " y"), (None, long), (10, "same row same row same row"), (10, "same row same row same row")]
    found = neardup.near_duplicates(docs(data)).collect()
    component = {(r["doc_id"], r["component_id"]) for r in found}
    assert len(found) == len(data)
    # Only A-Z is folded.
    assert component == {(i, i) for i in (1, 2, 3, 4, 6, 7, 8, 10)} | {(5, 4), (9, 8), (None, 8)}
    assert [r["n_shingles"] for r in found if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]


def test_one_of_each_group_stays_with_all_columns(docs):
    text = "a few words that make one document of its own"
    data = [(2, text), (1, text), (1, text), (3, None), (4, ""), (5, "other words altogether in this one here")]
    table = docs(data).withColumn("text_key", F.lit("mine")).withColumn("registers", F.lit(0))
    found = neardup.keep_one(table)
    assert found.columns == table.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3, 4, 5]


def test_empty_table(docs):
    assert neardup.near_duplicates(docs([])).count() == 0
    assert neardup.keep_one(docs([])).count() == 0


@pytest.mark.parametrize("size", [8, 60, 600, 6000])
def test_estimate_is_close(size):
    pick = np.random.default_rng(size)
    left, right, truth = [], [], []
    for _ in range(60):
        union = np.unique(pick.integers(0, 2**64, size, np.uint64))
        pick.shuffle(union)
        a, b = np.sort(union[: size * 7 // 8]), np.sort(union[size // 8 :])
        left.append(neardup.registers(a))
        right.append(neardup.registers(b))
        truth.append(len(np.intersect1d(a, b)) / size)
    a, b, n = np.array(left), np.array(right), np.full(60, size * 7 // 8)
    rates = neardup.collision_rates()
    error = neardup.estimate(a, b, n, n, rates) - truth
    assert abs(error.mean()) < 0.02 and error.std() < 0.05
    assert neardup.may_link(a, b, n, n, rates).all()


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_pairs_of_packs_do_not_depend_on_batches(batch):
    sets = [np.sort(np.arange(i, i + 60, dtype=np.uint64) * np.uint64(2**58 + 12345)) for i in (0, 3, 6, 40)]
    preferences = neardup.Preferences()
    rows = []
    for pack in (1, 2, 5):
        for v, s in enumerate(sets):
            codes = neardup.registers(s)
            bands = neardup.packed(codes[preferences.sources(codes > 0)]).tolist()
            rows.append((pack, pack == 5, v % 2, v, v, 60, bands, neardup.packed(codes).tolist()))
    # Every band counts as the first shared one here.
    names = ["pack", "across", "block", "v", "root", "n", "bands", "registers"]
    table = pa.table([pa.array(x) for x in zip(*rows)], names)
    shared = [np.argmax(np.array(rows[0][6]) == np.array(r[6])) for r in rows]
    table = table.append_column("band", pa.array([int(x) for x in shared], pa.int32()))
    found = [tuple(r.values()) for b in neardup._pairs_inside(iter(table.to_batches(batch))) for r in b.to_pylist()]
    whole = [tuple(r.values()) for b in neardup._pairs_inside(iter(table.to_batches())) for r in b.to_pylist()]
    assert sorted(found) == sorted(whole)
    assert all({a, b} <= {0, 1, 2} for a, b in found)


@pytest.mark.parametrize("block", [2, 7])
def test_blocks_lose_no_pair(docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    data = corpus(3)
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(data)).collect()}
    assert found == brute_force(data)


def test_empty_registers_are_filled_alike_by_both_ways():
    preferences = neardup.Preferences()
    filled = np.zeros(neardup.REGISTERS, bool)
    filled[np.random.default_rng(0).choice(neardup.REGISTERS, 200, replace=False)] = True
    chosen = np.flatnonzero(filled)
    by_rank = chosen[preferences.rank[:, chosen].argmin(axis=1)]
    by_rank[chosen] = chosen
    assert (preferences.sources(filled) == by_rank).all()


def test_long_chains_are_one_component(rows):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7)]
    found = {r["v"]: r["root"] for r in connected(rows(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert connected(rows([], "a long, b long")).count() == 0
