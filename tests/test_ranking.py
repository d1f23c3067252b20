"""Features, metrics, re-ranking and ranker training on hand-made rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from citesift.functions.text import token_list
from citesift.operators import metrics as M
from citesift.operators import relevance
from citesift.operators.evaluation import candidates, evaluate_ranking
from citesift.operators import features
from citesift.operators.features import (
    BatchPairScorer,
    Bm25Scorer,
    corpus_stats,
    group_sizes,
    label_candidates,
    rank_features,
    ranking_examples,
    with_query_tokens,
)
from citesift.operators.ltr import (
    RankerConfig,
    best_trial,
    fit_ranker,
    ranker_configs,
    train_ranker,
)
from citesift.operators.relevance import relevant_documents
from citesift.operators.rerank import LinearRanker, ModelRanker, rerank
from citesift.sources.models import load_model, save_model

RANKED = "query_id string, rank int, doc_id string, label double"


def ranked(rows, labels, query="q"):
    return rows([(query, i + 1, f"d{i}", float(x)) for i, x in enumerate(labels)], RANKED)


@pytest.mark.parametrize(
    ("labels", "k", "expected"),
    [
        ([1, 1, 0, 0], 4, 1.0),
        ([0, 0, 1], 3, 1 / math.log2(4)),
        ([0, 0, 0], 3, 0.0),
        ([0, 0, 0, 1], 3, 0.0),
    ],
)
def test_ndcg(rows, labels, k, expected):
    assert M.ndcg_at_k(ranked(rows, labels), k).first().ndcg == pytest.approx(expected)


@pytest.mark.parametrize(("labels", "expected"), [([0, 0, 1, 1], 1 / 3), ([0, 0, 0], 0.0), ([1], 1.0)])
def test_mrr(rows, labels, expected):
    assert M.mrr(ranked(rows, labels)).first().mrr == pytest.approx(expected)


def test_dcg(rows):
    assert M.dcg(ranked(rows, [1, 0, 1])).first().dcg == pytest.approx(1 + 1 / 2)
    assert M.dcg(ranked(rows, [1, 0, 1]), 2).first().dcg == pytest.approx(1.0)


def recall(rows, docs, relevant, k):
    order = rows([("q", i + 1, d, float(d in relevant)) for i, d in enumerate(docs)], RANKED)
    pairs = rows([("q", d) for d in relevant], "query_id string, doc_id string")
    return M.recall_at_k(order, pairs, k).first().recall


def test_recall_counts_documents_not_chunks(rows):
    assert recall(rows, ["a", "x", "b"], {"a", "b"}, 2) == 0.5
    assert recall(rows, ["a", "a", "a"], {"a", "b"}, 3) == 0.5
    assert recall(rows, ["a"], set(), 3) == 0.0


def plain_ndcg(labels, k):
    def dcg(xs):
        return sum(x / math.log2(i + 2) for i, x in enumerate(xs[:k]))

    best = dcg(sorted(labels, reverse=True))
    return dcg(labels) / best if best else 0.0


def test_metrics_equal_plain_python_on_random_groups(rows):
    rng = random.Random(5)
    groups = {f"q{i}": [rng.choice([0, 0, 1]) for _ in range(rng.randint(1, 12))] for i in range(80)}
    data = [(q, i + 1, f"d{i}", float(x)) for q, xs in groups.items() for i, x in enumerate(xs)]
    df = rows(data, RANKED).repartition(7)
    found = {r.query_id: r.ndcg for r in M.ndcg_at_k(df, 5).collect()}
    first = {r.query_id: r.mrr for r in M.mrr(df).collect()}
    for q, xs in groups.items():
        assert found[q] == pytest.approx(plain_ndcg(xs, 5))
        assert first[q] == pytest.approx(1 / (xs.index(1) + 1) if 1 in xs else 0.0)


def test_mean_ndcg_breaks_ties_by_incoming_order(rows):
    data = [("q", i + 1, "d", float(i == 0), 0.9 if i == 4 else 0.5) for i in range(6)]
    df = rows(data, RANKED + ", prediction double")
    # Position 5 moves up front, the relevant first row becomes second: 1 / log2(3) of an ideal 1.
    assert M.mean_ndcg(df, 5).first().mean_ndcg == pytest.approx(1 / math.log2(3))
    assert M.mean_ndcg(df.where("false"), 5).first().mean_ndcg == 0.0


FEATURED = (
    "query_id string, rank int, chunk_id string, doc_id string, source string, text string, "
    "dense_cosine double, cross_encoder_score double, lexical_overlap double"
)


def featured(rows, scores, query="q"):
    return rows(
        [(query, i + 1, f"c{i}", f"d{i}", "s", "t", s, 0.0, 0.0) for i, s in enumerate(scores)], FEATURED
    )


@pytest.mark.parametrize(
    ("scores", "expected"),
    [
        ([0.1, 0.9, 0.5], ["c1", "c2", "c0"]),
        ([0.5, 0.5, 0.5], ["c0", "c1", "c2"]),
        ([0.5, 0.9, 0.5], ["c1", "c0", "c2"]),
    ],
)
def test_rerank_order_and_ties(rows, scores, expected):
    df = rerank(featured(rows, scores), LinearRanker((1.0, 0.0, 0.0)))
    assert [r.chunk_id for r in df.orderBy("rerank_rank").collect()] == expected


def test_rerank_cut_and_empty(rows):
    df = featured(rows, [0.1, 0.9, 0.5])
    assert rerank(df, LinearRanker(), 2).count() == 2
    assert rerank(df.where("false"), LinearRanker(), 2).count() == 0


def candidate_rows(rows):
    data = [
        ("q", "Green Tea", "a", "d0", "green tea needs water", 0.9),
        ("q", "Green Tea", "b", "d1", "unrelated text", 0.1),
    ]
    df = rows(data, "query_id string, query string, chunk_id string, doc_id string, text string, score double")
    return with_query_tokens(df)


def test_features_keep_their_columns_apart(rows):
    def factory():
        return lambda pairs: [0.7 if "tea" in text else 0.2 for _, text in pairs]

    found = rank_features(candidate_rows(rows), BatchPairScorer(factory)).orderBy("chunk_id").collect()
    values = [(r.dense_cosine, r.cross_encoder_score, r.lexical_overlap) for r in found]
    assert values == [(0.9, 0.7, 1.0), (0.1, 0.2, 0.0)]


def test_missing_feature_inputs_are_an_error(rows):
    with pytest.raises(KeyError):
        rank_features(candidate_rows(rows).drop("score"), BatchPairScorer(lambda: None))


def test_bm25_equals_the_formula(rows):
    texts = ["apple banana apple", "banana cherry", "durian " * 9, "apple cherry cherry fig"]
    chunks = rows([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    scorer = Bm25Scorer.from_stats(*corpus_stats(chunks))
    queries = with_query_tokens(rows([("q", "Apple cherry, apple zzz"), ("n", "zzz")], "query_id string, query string"))
    pairs = chunks.withColumn("query_id", F.explode(F.array(F.lit("q"), F.lit("n"))))
    pairs = pairs.withColumn("text_tokens", token_list(F.col("text")))
    found = {
        (r.query_id, r.chunk_id): r.pair_score
        for r in scorer.score(pairs.join(scorer.prepare(queries), "query_id")).collect()
    }

    docs = [t.split() for t in texts]
    average = sum(map(len, docs)) / 4

    def bm25(doc):
        total = 0.0
        for token in ("apple", "cherry"):
            df, tf = sum(token in d for d in docs), doc.count(token)
            idf = math.log(1 + (4 - df + 0.5) / (df + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / average))
        return total

    best = max(map(bm25, docs))
    for i, d in enumerate(docs):
        assert found["q", f"c{i}"] == pytest.approx(bm25(d) / best)
        assert found["n", f"c{i}"] == 0.0


def test_examples_are_labelled_by_document_and_queries_without_hits_drop_out(rows):
    hits = rows([("q1", "A"), ("q1", "B"), ("q3", "C")], "query_id string, doc_id string")
    relevance = rows([("q1", "A"), ("q1", "A"), ("q2", "Z"), ("q3", "C")], "query_id string, doc_id string")
    found = ranking_examples(hits, relevance)
    assert sorted((r.query_id, r.doc_id, r.label) for r in found.collect()) == [
        ("q1", "A", 1.0), ("q1", "B", 0.0), ("q3", "C", 1.0)]
    assert sorted((r.query_id, r.n_candidates) for r in group_sizes(found).collect()) == [("q1", 2), ("q3", 1)]


def deltas(rows, values):
    return rows([(float(d), i, f"q{i}") for i, d in enumerate(values)], "delta double, seq bigint, query string")


@pytest.mark.parametrize(
    ("values", "expected"),
    [([0.2, -0.1, 0.0, 0.3, -0.4], (2, 2, 1)), ([1e-12, -1e-12], (0, 0, 2)), ([], (0, 0, 0))],
)
def test_uplift_counts(rows, values, expected):
    assert tuple(M.uplift_summary(deltas(rows, values)).first()) == expected


def test_uplift_extremes(rows):
    found = M.uplift_extremes(deltas(rows, [0.2, -0.4, 0.3, -0.4, 0.3])).first()
    assert (found.worst_query, found.best_query) == ("q1", "q4")
    assert tuple(M.uplift_extremes(deltas(rows, [0.0, 0.0])).first()) == (None, None, None, None)


def test_evaluation_credits_the_reranked_order(rows):
    first = featured(rows, [0.1, 0.9, 0.5], "q1")  # d1 is lifted to the front
    second = featured(rows, [0.9, 0.5, 0.1], "q2")
    relevance = rows([("q1", "d1"), ("q2", "d0")], "query_id string, doc_id string")
    per_query = evaluate_ranking(first.union(second), relevance, LinearRanker((1.0, 0.0, 0.0)), 5)
    found = {r.query_id: r for r in per_query.collect()}
    assert found["q1"].delta > 0 and found["q2"].delta == 0
    summary = M.ranking_summary(per_query).first()
    assert summary.reranked_ndcg == 1.0 > summary.dense_ndcg
    assert (summary.n_improved, summary.n_regressed, summary.n_tied) == (1, 0, 1)


def test_evaluation_of_nothing_is_an_error(rows):
    empty = evaluate_ranking(
        featured(rows, []), rows([], "query_id string, doc_id string"), LinearRanker(), 5
    )
    with pytest.raises(Exception, match="no labelled query"):
        M.ranking_summary(empty).collect()


def training_rows(rows, n_queries=8):
    rng = random.Random(2)
    data = []
    for q in range(n_queries):
        for i in range(10):
            label = float(i % 5 == 0)
            pair = 0.6 * label + 0.4 * rng.random()
            data.append((f"q{q}", q, i + 1, rng.random(), pair, rng.random(), label))
    return rows(data, "query_id string, seq int, rank int, dense_cosine double, "
                      "cross_encoder_score double, lexical_overlap double, label double")  # fmt: skip


@pytest.mark.parametrize("family", ["trees", "linear"])
def test_both_families_learn_to_rank(rows, tmp_path, family):
    examples = training_rows(rows)
    config = RankerConfig(family, step_size=0.3, depth=3, rounds=5, reg=0.001)
    trained = train_ranker(examples, configs=[config])
    assert trained.val_ndcg > 0.9
    save_model(trained.model, str(tmp_path / "m"))
    again = ModelRanker(load_model(str(tmp_path / "m"))).score(examples)
    assert M.mean_ndcg(again, 5, "rerank_score").first()[0] > 0.9
    assert set(again.columns) == {*examples.columns, "rerank_score"}


def test_training_needs_two_queries(rows):
    with pytest.raises(ValueError):
        train_ranker(training_rows(rows, 1))


def test_search_space():
    configs = ranker_configs(40)
    assert configs == ranker_configs(40)
    assert {c.family for c in configs} == {"trees", "linear"}
    assert all(0.01 <= c.step_size <= 0.3 and 2 <= c.depth <= 6 and 0.5 <= c.min_rows <= 5 for c in configs)
    assert {c.rounds for c in configs} == {50, 100, 200}


def test_best_trial(rows):
    df = rows([("b", 0.5), ("a", 0.5), ("c", None), ("d", float("nan"))], "trial string, metric double")
    assert tuple(best_trial(df).first()) == ("a", 0.5)
    with pytest.raises(Exception, match="no trial"):
        best_trial(df.where("trial = 'c'")).collect()


def test_relevant_documents_equal_brute_force(rows):
    rng = random.Random(9)
    words = ["a", "b", "c", "d"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    docs += [docs[0]] * 30
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7)] * 2
    passages += [docs[3], docs[0][: len(docs[0]) // 2].strip(), "nowhere to be found at all", ""]
    documents = rows([(f"d{i}", t) for i, t in enumerate(docs)], "doc_id string, text string")
    queries = rows([(f"q{i}", t) for i, t in enumerate(passages)], "query_id string, query string")
    found = {(r.query_id, r.doc_id) for r in relevant_documents(queries, documents).collect()}
    expected = {
        (f"q{i}", f"d{j}")
        for i, p in enumerate(passages)
        for j, d in enumerate(docs)
        if p.split() and f" {' '.join(p.split())} " in f" {' '.join(d.split())} "
    }
    assert found == expected
    assert relevant_documents(queries.where("false"), documents).count() == 0


def test_relevant_documents_with_one_passage_in_most_documents(rows, monkeypatch):
    shared = "the same five words and more of them everywhere"
    docs = [f"w{i} {shared} v{i}" for i in range(400)] + [shared.replace("more", "less"), None, ""]
    documents = rows([(f"d{i}", t) for i, t in enumerate(docs)], "doc_id string, text string")
    asked = [("q1", shared), ("q2", shared), ("q3", f"{shared} v7"), ("q4", "five words and less of"), ("q5", None)]
    queries = rows(asked, "query_id string, query string")
    expected = {(q, f"d{i}") for q in ("q1", "q2") for i in range(400)} | {("q3", "d7"), ("q4", "d400")}
    for limit in (relevance.BROADCAST_BYTES, 0):
        monkeypatch.setattr(relevance, "BROADCAST_BYTES", limit)
        found = [tuple(r) for r in relevant_documents(queries, documents).collect()]
        assert set(found) == expected and len(found) == len(expected)


def test_only_document_ids_move_texts(rows, capsys, monkeypatch):
    monkeypatch.setattr(relevance, "BROADCAST_BYTES", 0)
    documents = rows([("d1", "one two three four five six")], "doc_id string, text string")
    queries = rows([("q1", "two three four five six")], "query_id string, query string")
    relevant_documents(queries, documents).explain("formatted")
    moved = re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (.*)", capsys.readouterr().out)
    assert len(moved) >= 4
    for columns, how in moved:
        names = {c.split("#")[0] for c in columns.split(", ")}
        assert "hashpartitioning(doc_id" in how or names <= {"doc_id", "query_id", "passage", "start", "length"}


def test_bit_filter_keeps_all_that_match(rows):
    kept = rows([(i * 7919 - 10**9,) for i in range(500)], "run long")
    placed = rows([("d", i, i - 10**9) for i in range(0, 500 * 7919, 101)], "doc_id string, start int, run long")
    wanted = {i * 7919 - 10**9 for i in range(500)}
    found = [r.run for r in relevance._maybe_in(placed, kept).collect()]
    assert {r.run for r in placed.collect()} & wanted <= set(found)
    assert len(found) < placed.count() / 100


def test_label_join_ignores_other_queries(rows):
    hits = rows([("q1", "A"), ("q2", "A")], "query_id string, doc_id string")
    relevance = rows([("q2", "A")], "query_id string, doc_id string")
    found = {r.query_id: r.label for r in label_candidates(hits, relevance).collect()}
    assert found == {"q1": 0.0, "q2": 1.0}


def test_fit_is_deterministic(rows):
    examples = training_rows(rows)
    scores = [
        sorted(r.rerank_score for r in ModelRanker(fit_ranker(examples, RankerConfig("linear"))).score(examples).collect())
        for _ in range(2)
    ]
    assert scores[0] == scores[1]


def test_candidates_of_a_query_without_tokens(rows, spark):
    from citesift.operators.embedding import HashEncoder

    encoder = HashEncoder(16)
    chunks = rows([("a#0-x", "a", "s", 0, "apple"), ("b#0-x", "b", "s", 0, "fig")],
                  "chunk_id string, doc_id string, source string, chunk_index int, text string")
    index = encoder.encode(chunks)
    queries = encoder.encode(rows([("q", "!!!")], "query_id string, query string"), "query")
    found = candidates(queries, index, 5, Bm25Scorer.from_stats(*corpus_stats(chunks))).collect()
    assert [(r.score, r.cross_encoder_score, r.lexical_overlap) for r in found] == [(0.0, 0.0, 0.0)] * 2


def test_runs_are_rows_of_generated_code_and_the_filter_lets_all_of_them_through(rows):
    documents = rows([("a", "one two\tthree one two"), ("b", "x"), ("c", ""), ("d", None), (None, "x y")], "doc_id string, text string")
    runs = relevance._runs_of(documents, [1, 3])
    expected = []
    for d, text in [("a", "one two three one two"), ("b", "x"), (None, "x y")]:
        w = text.split()
        expected += [(d, i, " ".join(w[i : i + n])) for n in (1, 3) for i in range(len(w) - n + 1)]
    named = rows([(r, r.split()) for r in {e[2] for e in expected}], "name string, w array<string>")
    named = named.select("name", F.xxhash64("w").alias("run"))
    found = [(r.doc_id, r.start, r.name) for r in runs.join(named, "run").collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr) and runs.count() == len(expected)
    wanted = named.where("name in ('x', 'two three one')")
    assert {r.run for r in wanted.collect()} <= {r.run for r in relevance._maybe_in(runs, wanted).collect()}
    assert relevance._maybe_in(runs, wanted).count() < runs.count()
    assert "transform(" not in runs._jdf.queryExecution().optimizedPlan().toString()


def test_frequencies_are_added_up_however_often_a_task_passes_them_on(rows, monkeypatch):
    chunks = rows([("A b a",), (None,), ("b-c é",), ("",), ("c C b",)], "text string").coalesce(1)
    wanted = {"a": 1, "b": 3, "c": 2}
    for at_once in (1, 2, 100):
        monkeypatch.setattr(features, "COUNTED_TOKENS", at_once)
        frequency, size = corpus_stats(chunks)
        assert {r.token: r.df for r in frequency.collect()} == wanted
        assert tuple(size.first()) == (5, 8)
