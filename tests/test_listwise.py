"""Gradients of nDCG and the trees boosted on them."""

import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from citesift.operators import listwise
from citesift.operators import metrics as M
from citesift.operators.features import FEATURES
from citesift.operators.ltr import FAMILIES, RankerConfig, fit_ranker, ranker_configs, train_ranker, validation_ndcg
from citesift.operators.rerank import ModelRanker
from citesift.sources.models import load_model, save_model

ROWS = "query_id string, place long, features int, label double, score double"
EXAMPLES = "query_id string, seq int, rank int, dense_cosine double, cross_encoder_score double, lexical_overlap double, label double"


def plain_pulls(labels, scores):
    """Every pair of one query."""
    n = len(labels)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    at = [1 / math.log2(order.index(i) + 2) for i in range(n)]
    ideal = sum((2**y - 1) / math.log2(k + 2) for k, y in enumerate(sorted(labels, reverse=True)))
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if labels[i] > labels[j]:
                wrong = 1 / (1 + math.exp(scores[i] - scores[j]))
                swap = abs(2 ** labels[i] - 2 ** labels[j]) * abs(at[i] - at[j]) / ideal
                g[i] += wrong * swap
                g[j] -= wrong * swap
                for x in (i, j):
                    h[x] += wrong * (1 - wrong) * swap
    return g, h


def test_pulls_equal_all_pairs(rows):
    rng = random.Random(6)
    data, expected = [], {}
    for q in range(30):
        n = rng.randrange(1, 9)
        labels = [float(rng.choice([0, 0, 1, 2])) for _ in range(n)]
        scores = [rng.choice([0.0, 0.5, rng.gauss(0, 2)]) for _ in range(n)]
        data += [(f"q{q}", i, i, y, s) for i, (y, s) in enumerate(zip(labels, scores))]
        if max(labels) > 0:
            g, h = plain_pulls(labels, scores)
            expected |= {(f"q{q}", i): (g[i], h[i]) for i in range(n)}
    found = listwise.gradients(rows(data, ROWS).repartition(3)).collect()
    assert {(r.query_id, r.place) for r in found} == set(expected) and len(found) == len(expected)
    for r in found:
        assert (r.g, r.h) == pytest.approx(expected[r.query_id, r.place], abs=1e-9)


def test_no_pair_becomes_a_row_and_no_python(rows):
    plan = listwise.gradients(rows([("q", 1, 1, 1.0, 0.0)], ROWS))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan


def shifted(rows, n_queries, seed):
    """Relevant is what is highest within its query, among candidates of middling overlap. Queries differ in level."""
    rng, data = random.Random(seed), []
    for q in range(n_queries):
        level = rng.uniform(-3, 3)
        some = [(level + rng.random(), rng.random(), rng.random()) for _ in range(12)]
        good = sorted((x for x in some if 0.35 < x[2] < 0.65), reverse=True)[:2]
        rng.shuffle(some)
        data += [(f"s{seed}q{q}", q, i + 1, *x, float(x in good)) for i, x in enumerate(some)]
    return rows(data, EXAMPLES)


def test_listwise_beats_both_other_families(rows):
    train, test = shifted(rows, 80, 1).coalesce(1).cache(), shifted(rows, 40, 2).coalesce(1).cache()
    settings = {
        "listwise": RankerConfig("listwise", step_size=0.5, depth=4, rounds=8),
        "trees": RankerConfig("trees", step_size=0.5, depth=4, rounds=8),
        "linear": RankerConfig("linear", reg=0.001),
    }
    ndcg = {name: validation_ndcg(fit_ranker(train, c), test) for name, c in settings.items()}
    assert ndcg["listwise"] > ndcg["trees"] + 0.05 and ndcg["listwise"] > ndcg["linear"] + 0.05, ndcg


def test_listwise_is_tried_by_default(monkeypatch, rows):
    from citesift.operators import ltr

    seen = []
    monkeypatch.setattr(ltr, "fit_ranker", lambda examples, config: seen.append(config.family) or ltr.PipelineModel([]))
    monkeypatch.setattr(ltr, "validation_ndcg", lambda *args: 0.5)
    train_ranker(shifted(rows, 4, 6), trials=3)
    assert set(seen) == set(FAMILIES)


def test_a_listwise_model_is_saved_and_loaded(rows, tmp_path):
    train = shifted(rows, 10, 3)
    model = fit_ranker(train, RankerConfig("listwise", step_size=0.3, depth=2, rounds=3))
    save_model(model, str(tmp_path / "m"))
    order = ["query_id", "rank"]
    mine = ModelRanker(model).score(train).orderBy(order).collect()
    assert ModelRanker(load_model(str(tmp_path / "m"))).score(train).orderBy(order).collect() == mine
    assert M.mean_ndcg(ModelRanker(model).score(train), 5, "rerank_score").first()[0] > 0.5


def test_one_round_is_the_newton_step_of_its_leaves(rows):
    """A tree of depth 0 has one leaf: sum(g) / (sum(h) + floor), which is zero over whole queries."""
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(shifted(rows, 6, 4))
    model = listwise.fit_listwise(train.select("query_id", "features", "label"), 0.5, 1, 1, 1)
    scored = model.transform(train.withColumn("score", F.lit(0.0)).withColumn("place", F.col("rank").cast("long")))
    placed = train.select("query_id", F.col("rank").cast("long").alias("place"), "features", "label", F.lit(0.0).alias("score"))
    leaves = {}
    steps = {(r.query_id, r.place): r.prediction for r in scored.collect()}
    for r in listwise.gradients(placed).collect():
        leaves.setdefault(round(steps[r.query_id, r.place], 9), []).append((r.g, r.h + listwise.LEAST_CURVATURE))
    assert len(leaves) == 2
    for step, found in leaves.items():
        assert step == pytest.approx(0.5 * sum(g for g, _ in found) / sum(h for _, h in found), abs=1e-6)


def test_without_contrast_there_is_nothing_to_learn(rows):
    train = shifted(rows, 3, 5).withColumn("label", F.lit(0.0))
    with pytest.raises(ValueError, match="relevant"):
        fit_ranker(train, RankerConfig("listwise", rounds=2))


def test_all_families_are_drawn():
    assert [c.family for c in ranker_configs(6, families=FAMILIES)] == [*FAMILIES, *FAMILIES]
