"""Splits, routing, classification metrics."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from citesift.operators import metrics as M
from citesift.operators import splits as S
from citesift.operators.contracts import (
    check_training_sets,
    check_vocabulary,
    shared_texts,
    vocabulary_drift,
)
from citesift.operators.guardrail import admitted, refused
from citesift.operators.logistic import Fit, fit_jointly
from citesift.operators.numbering import (
    hash_bucket,
    hash_digits,
    hash_order,
    number_rows,
    range_bucketed,
    sequence_bucket,
)
from citesift.operators.routing import (
    INTENTS,
    OUT_OF_SCOPE,
    CentroidRouter,
    LogisticRouter,
    RouterConfig,
    evaluate_router,
    pick_class,
    router_configs,
    train_router,
    with_vector,
)
from citesift.sources.models import load_model, save_model


def test_numbering_equals_a_plain_window_on_a_dominating_group(rows):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.7 else rng.choice("ab"), i) for i in range(2000)]
    df = rows(data, "g string, id int").repartition(6)
    order = hash_order("id")
    numbered = number_rows(df, ["g"], [order, F.col("id")], hash_bucket(order))
    plain = df.selectExpr("g", "id", "row_number() over (partition by g order by md5(string(id)), id) as p")
    both = numbered.join(plain, ["g", "id"])
    assert both.count() == 2000
    assert both.where("position <> p").count() == 0


def test_numbering_of_null_groups_and_sequences(rows):
    df = rows([(None, 5), (None, 3), ("x", 1)], "g string, seq int")
    found = number_rows(df, ["g"], [F.col("seq")], sequence_bucket(F.col("seq"), 2)).collect()
    assert sorted((r.g or "", r.seq, r.position) for r in found) == [("", 3, 1), ("", 5, 2), ("x", 1, 1)]


@pytest.mark.parametrize("gap", [1, 10**7, 10**15])
def test_ranges_number_sparse_ids_in_many_buckets(rows, gap):
    ids = [i * gap - 50 for i in range(500)]
    df = rows([(i,) for i in ids[::-1]] + [(None,)], "seq long")
    bucketed = range_bucketed(df, "seq", 501, bucket_rows=50)
    sizes = [r["count"] for r in bucketed.groupBy("_range").count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 100
    found = {r.seq: r.position for r in number_rows(bucketed, [], [F.col("seq")], F.col("_range")).collect()}
    assert found == {i: n + 1 for n, i in enumerate(ids)}


def test_ranges_of_copies_and_of_nothing(rows):
    one = range_bucketed(rows([(7,)] * 40, "seq int"), "seq", 40, bucket_rows=4)
    assert number_rows(one, [], [F.col("seq")], F.col("_range")).agg(F.max("position")).first()[0] == 40
    assert range_bucketed(rows([], "seq int"), "seq", 0).count() == 0
    assert range_bucketed(rows([(None,)] * 9, "seq int"), "seq", 9, bucket_rows=2).count() == 0


def test_hash_digits_grow_with_the_rows():
    assert [hash_digits(n, 10) for n in (0, 160, 161, 2_561, 10**9)] == [1, 1, 2, 3, 7]


def test_prefix_split_takes_the_first_queries(rows):
    for n, expected in [(10, 3), (2, 1), (1, 1), (7, 2)]:
        df = rows([(f"q{i}", i * 10) for i in range(n)], "query_id string, seq int")
        kept = S.prefix_split(df).where("is_validation").orderBy("seq").collect()
        assert [r.query_id for r in kept] == [f"q{i}" for i in range(expected)]


@pytest.mark.parametrize(
    ("counts", "total"),
    [({"a": 6, "b": 6, "c": 6}, 6), ({"a": 31, "b": 31, "c": 31}, 28), ({"a": 1, "b": 99}, 30)],
)
def test_holdout_quotas(counts, total):
    quotas = S.holdout_quotas(counts)
    assert sum(quotas.values()) == total
    for c, n in counts.items():
        assert abs(quotas[c] - total * n / sum(counts.values())) < 1


def labelled(rows, per_class=6):
    data = []
    for c, name in enumerate(INTENTS):
        for i in range(per_class):
            vector = [0.0] * 3
            vector[c] = 1.0
            data.append((f"{name}-{i}", name, vector))
    return rows(data, "query_id string, intent string, embedding array<float>")


def test_stratified_holdout_and_folds(rows):
    df = labelled(rows)
    test = S.stratified_holdout(df, "intent", "query_id").where("is_test")
    assert {r.intent: r["count"] for r in test.groupBy("intent").count().collect()} == dict.fromkeys(INTENTS, 2)
    folds = S.stratified_folds(df, "intent", "query_id", 3)
    assert {r["count"] for r in folds.groupBy("intent", "fold").count().collect()} == {2}
    few = S.stratified_folds(labelled(rows, 2), "intent", "query_id", 5)
    assert sorted(r.fold for r in few.select("fold").distinct().collect()) == [0, 1]


@pytest.mark.parametrize(("smallest", "folds", "expected"), [(1, 3, 2), (2, 3, 2), (9, 3, 3)])
def test_fold_count(rows, smallest, folds, expected):
    counts = rows([("a", smallest), ("b", 50)], "label string, n bigint")
    assert S.fold_count(counts, folds).first().n_folds == expected


def test_predicted_class_is_the_first_maximum_in_alphabetical_order(rows):
    classes = sorted(INTENTS)
    df = rows([([0.1, 0.7, 0.2],), ([0.4, 0.2, 0.4],)], "p array<double>")
    intent, confidence = pick_class(F.col("p"), classes)
    found = [tuple(r) for r in df.select(intent, confidence).collect()]
    assert found == [(OUT_OF_SCOPE, 0.7), ("factual", 0.4)]


def test_centroid_router(rows):
    df = labelled(rows)
    router = CentroidRouter.fit(df)
    routed = router.route(df.withColumnRenamed("intent", "label"))
    assert routed.where("intent <> label").count() == 0
    assert routed.first().confidence == 1.0
    nothing = router.route(rows([("q", [0.0, 0.0, 0.0])], "query_id string, embedding array<float>")).first()
    assert (nothing.intent, nothing.confidence) == ("factual", 0.0)


def test_trained_router_round_trip_and_holdout(rows, tmp_path):
    df = labelled(rows)
    trained = train_router(df, trials=2, parallelism=2)
    assert trained.cv_f1 == 1.0
    save_model(trained.model, str(tmp_path / "router"))
    router = LogisticRouter(load_model(str(tmp_path / "router")))
    assert router.classes == sorted(INTENTS)
    routed = router.route(df.withColumnRenamed("intent", "actual"))
    assert routed.where("intent <> actual").count() == 0
    assert routed.where("confidence > 0.5 and confidence <= 1").count() == df.count()

    evaluated = evaluate_router(df, RouterConfig(10.0, False))
    report = evaluated.withColumn("listed", F.to_json("per_class_f1")).first()
    assert (report.n_test, report.holdout_macro_f1, report.holdout_accuracy) == (6, 1.0, 1.0)
    assert list(json.loads(report.listed)) == sorted(INTENTS)


def noisy(rows, n_classes, n=240):
    """Classes that overlap, a feature that never varies and one that rarely does."""
    rng = random.Random(7)
    data = []
    for i in range(n):
        label = min(int(rng.random() * n_classes * 1.4), n_classes - 1)
        vector = [rng.gauss(1.0 if c == label else 0.0, 1.0) for c in range(3)] + [0.1, float(i % 7 == 0)]
        data.append((float(label), vector, i % 3, 1.0, 0.5 + rng.random()))
    return rows(data, "label double, embedding array<double>, fold int, even double, uneven double")


@pytest.mark.parametrize("n_classes", [2, 3])
def test_joint_fits_end_where_single_fits_end(rows, n_classes):
    df = noisy(rows, n_classes).repartition(3).persist()
    fits = [Fit(f, p, w) for f in range(3) for p, w in [(1e-4, "even"), (0.2, "uneven")]]
    found, counts = fit_jointly(df, fits, n_classes, 1000, 1e-4)
    counted = {(r.fit, r.label, r.prediction): r.n for r in counts.collect()}
    expected = {}
    for i, (fit, weights) in enumerate(zip(fits, found, strict=True)):
        single = LogisticRegression(
            maxIter=1000, tol=1e-4, regParam=fit.penalty, standardization=False, weightCol=fit.weight
        ).fit(with_vector(df.where(F.col("fold") != fit.held_out)))
        coefficients = single.coefficientMatrix.toArray()
        assert weights[-len(coefficients) :, :-1] == pytest.approx(coefficients, abs=1e-6)
        intercepts = weights[:, -1] - weights[:, -1].mean() if n_classes > 2 else weights[1:, -1]
        assert intercepts == pytest.approx(single.interceptVector.toArray(), abs=1e-6)
        scored = single.transform(with_vector(df.where(F.col("fold") == fit.held_out)))
        for r in scored.groupBy("label", "prediction").count().collect():
            expected[i, r["label"], r["prediction"]] = r["count"]
    assert counted == expected


def test_joint_fits_of_one_class_and_of_odd_vectors(rows):
    schema = "label double, embedding array<float>, fold int, w double"
    some = rows([(1.0, [float(i), 2.0], i % 2, 1.0) for i in range(6)], schema)
    found, counts = fit_jointly(some, [Fit(0, 0.1, "w")], 3, 10, 1e-4)
    assert list(np.isinf(found[0][:, -1])) == [False, True, False]
    assert [tuple(r) for r in counts.collect()] == [(0, 1.0, 1.0, 3)]
    with pytest.raises(ValueError, match="fold 0 is empty"):
        fit_jointly(some.where("fold = 0"), [Fit(0, 0.1, "w")], 3, 10, 1e-4)
    odd = rows([(float(i), [float("nan"), 2.0], i, 1.0) for i in range(2)], schema)
    with pytest.raises(ValueError, match="NaN"):
        fit_jointly(odd, [Fit(0, 0.1, "w")], 2, 10, 1e-4)


def test_more_trials_do_not_read_the_rows_more_often(rows, spark):
    df = labelled(rows)
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for trials in (1, 6):
        spark.sparkContext.setJobGroup(f"trials-{trials}", "router trials")
        train_router(df, trials=trials, parallelism=1)
        jobs[trials] = len(tracker.getJobIdsForGroup(f"trials-{trials}"))
    spark.sparkContext.setJobGroup("other", "other tests")
    assert jobs[6] < 2 * jobs[1]


def test_router_search_space():
    configs = router_configs(50)
    assert configs == router_configs(50)
    assert all(0.01 <= c.C <= 100 for c in configs)
    assert {c.balanced for c in configs} == {True, False}
    assert min(math.log(c.C) for c in configs) < 0 < max(math.log(c.C) for c in configs)


def test_f1_counts_predicted_only_classes_in_the_macro_mean(rows):
    # Class c is never true: it lowers the macro mean but is not listed per class.
    df = rows([("a", "a"), ("a", "c"), ("b", "b")], "label string, prediction string")
    report = M.f1_report(df).first()
    assert report.macro_f1 == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert report.accuracy == pytest.approx(2 / 3)
    assert report.per_class_f1 == {"a": pytest.approx(2 / 3), "b": 1.0}
    assert report.n_test == 3


def test_a_class_that_is_never_predicted_scores_zero(rows):
    df = rows([("a", "b"), ("b", "b")], "label string, prediction string")
    assert M.f1_report(df).first().per_class_f1["a"] == 0.0


def test_guardrail_names_one_label():
    assert OUT_OF_SCOPE in INTENTS


def test_guardrail_branches(rows):
    routed = rows([("1", "factual"), ("2", OUT_OF_SCOPE)], "query_id string, intent string")
    assert [r.query_id for r in refused(routed).collect()] == ["2"]
    assert [r.query_id for r in admitted(routed).collect()] == ["1"]


def test_set_contracts(rows):
    train, test = rows([("a",), ("b",)], "query string"), rows([("c",)], "query string")
    corpus = rows([("x",)], "doc_id string")
    check_training_sets(train, test, rows([("x",)], "doc_id string"), corpus)
    assert shared_texts(train, train).count() == 2
    with pytest.raises(ValueError, match="overlap"):
        check_training_sets(train, train, corpus, corpus)
    with pytest.raises(ValueError, match="do not exist"):
        check_training_sets(train, test, rows([("gone",)], "doc_id string"), corpus)
    labels = rows([("a",), ("b",)], "label string")
    check_vocabulary(labels, ["b", "a"])
    assert sorted(map(tuple, vocabulary_drift(labels, ["a", "c"]).collect())) == [
        ("b", "undeclared"), ("c", "unused")]
    with pytest.raises(ValueError):
        check_vocabulary(labels, ["a"])
