import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from citesift.llm import mixing

KINDS = {"good": "calm plain useful", "poor": "### $$$ click", "toxic": "nasty vile awful"}


def corpus(n=240):
    pick = np.random.default_rng(5)
    data, labels = [], []
    for i in range(n):
        kind = ("good", "good", "poor", "toxic")[i % 4]
        words = [f"w{k}" for k in pick.integers(0, 80, pick.integers(10, 60))] + KINDS[kind].split()
        data.append((i, " ".join(words)))
        if i % 3 == 0:
            labels.append((i, kind))
    return data, labels


def solve(p, t, targets, steps=4000):
    """Projected gradient with small steps in the same metric, one rate per document."""
    w, total = np.ones(len(t)), t.sum()
    inverse = np.linalg.pinv((p * t[:, None]).T @ p / total, rcond=1e-9)
    for _ in range(steps):
        w = np.maximum(0, w - 0.2 * p @ (inverse @ ((w * t) @ p / total - targets)))
    return w


def rated(df, labels, targets):
    member, m, rate = mixing.mixing_rates(df, labels, targets)
    found = member.select("doc_id", m["n_tokens"].alias("t"), m["posterior"].alias("p"), rate.alias("w"))
    found = found.orderBy("doc_id").collect()
    return [np.array([r[c] for r in found], float) for c in ("t", "p", "w")]


@pytest.mark.parametrize("targets", [{"good": 0.8, "poor": 0.1, "toxic": 0.1}, {"good": 1.0, "poor": 0.0, "toxic": 0.0}])
def test_totals_meet_targets_or_come_as_near_as_can_be(docs, rows, targets):
    data, labels = corpus()
    t, p, w = rated(docs(data), rows(labels, "doc_id long, domain string"), targets)
    p /= mixing.GRAIN
    goal = np.array([targets[d] for d in sorted(targets)])
    assert (w >= 0).all() and p.sum(axis=1) == pytest.approx(1)
    reached = (w * t) @ p / t.sum()
    expected = solve(p, t, goal)
    assert reached == pytest.approx((expected * t) @ p / t.sum(), abs=0.04)
    if min(targets.values()) > 0:
        assert reached == pytest.approx(goal, abs=1e-6)


def test_classifier_knows_the_domains(docs, rows):
    data, labels = corpus()
    _, p, _ = rated(docs(data), rows(labels, "doc_id long, domain string"), None)
    unlabelled = [i for i in range(len(data)) if i % 3]
    kinds = [sorted(KINDS).index(("good", "good", "poor", "toxic")[i % 4]) for i in unlabelled]
    assert (p[unlabelled].argmax(axis=1) == kinds).mean() > 0.8


def test_copies_follow_rates(spark):
    df = spark.range(20_000).select("id", mixing.copies_of(F.lit(1.3), F.col("id")).alias("n"))
    counts = {r["n"]: r["count"] for r in df.groupBy("n").count().collect()}
    assert set(counts) == {1, 2} and counts[2] / 20_000 == pytest.approx(0.3, abs=0.02)


def test_mixed_rows_keep_their_columns(docs, rows):
    data, labels = corpus(80)
    data += [(500, None), (501, ""), (501, ""), (None, "w1 w2"), (502, "w3 " * 50_000)]
    table = docs(data).withColumn("membership", F.lit("mine")).withColumn("copy", F.lit(3))
    found = mixing.mix(table, rows(labels + [(0, None), (None, "good"), (1, "unheard")], "doc_id long, domain string"))
    assert found.columns == table.columns
    assert {tuple(r) for r in found.collect()} <= {tuple(r) for r in table.collect()}


def test_no_labels_no_rows(docs, rows):
    none = rows([], "doc_id long, domain string")
    assert mixing.mix(docs([]), none).count() == 0
    t, p, w = rated(docs([(1, "a b"), (2, None)]), none, None)
    assert t.tolist() == [2, 0] and p.sum(axis=1).tolist() == [1000, 1000] and np.isfinite(w).all()


def test_thousandths_sum_up():
    pick = np.random.default_rng(0)
    for p in pick.dirichlet([0.2, 1, 3], 200):
        whole = mixing.thousandths(p)
        assert whole.sum() == 1000 and np.abs(whole / 1000 - p).max() < 1e-3


SKEWED = [(0.6, 0.35, 0.05), (0.4, 0.3, 0.3), (0.3, 0.6, 0.1)]


def grouped(spark, shares, n=3000):
    """Soft posteriors around the present shares."""
    pick = np.random.default_rng(7)
    kind = pick.choice(3, n, p=shares)
    p = pick.dirichlet([0.7] * 3, n) * 0.4 + np.eye(3)[kind] * 0.6
    rows = [(mixing.thousandths(x).tolist(), int(t)) for x, t in zip(p, pick.integers(10, 400, n))]
    return spark.createDataFrame(rows, "posterior array<int>, tokens long")


@pytest.mark.parametrize("shares", SKEWED)
def test_targets_are_met_from_skewed_shares(spark, shares):
    groups, goal = grouped(spark, shares), [0.85, 0.09, 0.06]
    rate = mixing.rate_of(F.col("posterior"), mixing.fit_rates(groups, goal))
    found = groups.select("posterior", "tokens", rate.alias("w")).collect()
    p, t, w = [np.array([r[c] for r in found], float) for c in ("posterior", "tokens", "w")]
    assert (w >= 0).all() and (w * t) @ p / mixing.GRAIN / t.sum() == pytest.approx(goal, abs=1e-6)


def test_a_mixture_out_of_reach_is_the_nearest_and_says_so(spark):
    groups = spark.createDataFrame([([700, 200, 100], 10), ([300, 600, 100], 30), ([200, 200, 600], 5)], "posterior array<int>, tokens long")
    fit = mixing.fit_rates(groups, [1.0, 0.0, 0.0])
    assert not fit.met and fit.targets.tolist() == [1, 0, 0]
    found = groups.collect()
    p, t = np.array([r[0] for r in found]) / mixing.GRAIN, np.array([r[1] for r in found], float)
    w = solve(p, t, fit.targets, 20_000)
    assert fit.reached == pytest.approx((w * t) @ p / t.sum(), abs=1e-5)


LONE = {
    "one domain": [([1000, 0, 0], 700)],
    "an absent domain": [([900, 100, 0], 500), ([200, 800, 0], 300), ([0, 1000, 0], 20)],
    "fifty tokens of 10^7": [([1000, 0, 0], 10**7), ([0, 1000, 0], 10**6), ([0, 0, 1000], 50)],
    "a trace in every text": [([999, 1, 0], 10**6), ([990, 0, 10], 10**4), ([0, 999, 1], 10**3)],
}


@pytest.mark.parametrize("case", LONE)
@pytest.mark.parametrize("goal", [[0.9, 0.06, 0.04], [0.2, 0.3, 0.5]])
def test_absent_and_tiny_domains(spark, case, goal):
    groups = spark.createDataFrame(LONE[case], "posterior array<int>, tokens long")
    fit = mixing.fit_rates(groups, goal)
    p, t = np.array([g[0] for g in LONE[case]]) / mixing.GRAIN, np.array([g[1] for g in LONE[case]], float)
    w = np.maximum(0, 1 - p @ fit.pull)
    assert np.isfinite(w).all() and fit.reached == pytest.approx((w * t) @ p / t.sum(), abs=1e-9)
    wanted = solve(p, t, np.array(goal), 60_000)
    reached = (wanted * t) @ p / t.sum()
    metric = np.linalg.pinv((p * t[:, None]).T @ p / t.sum(), rcond=1e-9)
    mine, brute = fit.reached - goal, reached - goal
    assert mine @ metric @ mine <= brute @ metric @ brute + 1e-5
    assert np.abs(fit.reached - reached).max() < 1e-5 or mine @ metric @ mine < brute @ metric @ brute


def test_blocks_of_any_size_give_the_same_model(monkeypatch):
    pick = np.random.default_rng(3)
    length = pick.integers(1, 40, 50)
    at = np.concatenate([np.sort(pick.choice(300, n, replace=False)) for n in length]).astype(np.int32)
    sample = mixing.Sample(at, pick.random(len(at), np.float32), np.cumsum(length) - length, pick.integers(0, 3, 50), pick.random(50))
    models = []
    for entries in (1, 16, 1 << 20):
        monkeypatch.setattr(mixing, "BLOCK_ENTRIES", entries)
        models.append(mixing.fit(sample, 3))
    assert np.abs(models[0].weights).max() > 0
    for model in models[1:]:
        assert (model.weights == models[0].weights).all() and (model.bias == models[0].bias).all()


def test_the_driver_holds_few_bytes_for_each_entry_of_the_sample(docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "EPOCHS", 2)
    pick = np.random.default_rng(11)
    words = [f"w{k}" for k in range(8000)]
    data = [(i, " ".join(pick.choice(words, 1000, replace=False))) for i in range(300)]
    table, known = docs(data), rows([(i, sorted(KINDS)[i % 3]) for i in range(300)], "doc_id long, domain string")
    mixing.fit_domains(table.limit(3), known, sorted(KINDS))  # imports
    tracemalloc.start()
    try:
        mixing.fit_domains(table, known, sorted(KINDS))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    entries = 300 * 900
    assert peak < 40 * entries
