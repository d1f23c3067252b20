"""Encoders and exact search."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citesift.functions import vectors
from citesift.functions.text import lower_bytes, tokens_of
from citesift.functions.vectors import TokenBuckets, bucket_labels, dot, l2_normalize, token_buckets
from citesift.operators.embedding import BatchEncoder, HashEncoder, IdfEncoder, embed_chunks
from citesift.operators.topk import attach_passages, dense_topk

INDEX = "chunk_id string, doc_id string, source string, chunk_index int, text string, embedding array<float>"


def plain_embedding(text, dim):
    counts = [0] * dim
    for token in re.findall("[a-z0-9]+", text.lower()):
        counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    return [c / norm if norm else 0.0 for c in counts]


@pytest.mark.parametrize("dim", [16, 64, 100, 256])
def test_hash_encoder_equals_plain_python(rows, dim):
    texts = ["Alpha beta beta, gamma!", "", "ÉÈ ...", "x1 x2 x3 x1", "the " * 50]
    df = rows([(t,) for t in texts], "text string")
    found = {r.text: r.embedding for r in HashEncoder(dim).encode(df).collect()}
    for t in texts:
        assert found[t] == pytest.approx(plain_embedding(t, dim), abs=1e-7)


@pytest.mark.parametrize("dim", [16, 100])
def test_idf_encoder_equals_plain_python(rows, dim):
    corpus = ["the cat", "the dog the dog", "the bird", "", None]
    df = rows([(t,) for t in corpus], "text string")
    fitted = IdfEncoder(dim).fit(df)
    held = [{i for i, x in enumerate(plain_embedding(t or "", dim)) if x} for t in corpus]
    rarity = [math.log(6 / (1 + sum(b in h for h in held))) + 1 for b in range(dim)]
    assert fitted.rarity == pytest.approx(rarity)
    asked = ["the dog", "unseen words", "", None, "cat cat the"]
    found = [r.embedding for r in fitted.encode(rows([(t,) for t in asked], "text string").coalesce(1)).collect()]
    for text, vector in zip(asked, found):
        plain = np.array(plain_embedding(text or "", dim)) * rarity
        assert vector == pytest.approx(plain / (np.linalg.norm(plain) or 1), abs=1e-6)


def test_idf_ranks_the_rare_word_first(rows):
    corpus = ["the the the the cat", "the dog sat there", "the bird", "the the the of the"]
    fitted = IdfEncoder(256).fit(rows([(t,) for t in corpus], "text string"))
    texts = rows([(t,) for t in ["the cat", *corpus]], "text string").coalesce(1)
    found = np.array([r.embedding for r in fitted.encode(texts).collect()])
    plain = np.array([r.embedding for r in HashEncoder(256).encode(texts).collect()])
    assert np.argmax(found[1:] @ found[0]) == 0
    # Without weights the frequent word alone decides.
    assert (found[1:] @ found[0])[3] < (plain[1:] @ plain[0])[3]


def test_idf_encoder_must_be_fitted(rows):
    with pytest.raises(ValueError, match="no weights"):
        IdfEncoder(16).encode(rows([("a",)], "text string"))
    with pytest.raises(ValueError, match="3 weights for 16"):
        IdfEncoder(16, [1.0, 1.0, 1.0])
    assert IdfEncoder(16).fit(rows([], "text string")).rarity == [1.0] * 16


def test_normalisation_keeps_zero_vectors(rows):
    df = rows([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    found = [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()]
    assert found == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(dot(F.col("v"), F.col("v"))).first()[0] == 25.0


def test_plugin_encoder_is_built_once_per_task_and_normalised(rows):
    def factory():
        state = {"calls": 0}

        def model(texts):
            state["calls"] += 1
            return [[float(len(t)), float(state["calls"])] for t in texts]

        return model

    df = rows([("a" * i,) for i in range(1, 8)], "text string").coalesce(1)
    encoder = BatchEncoder(factory, dim=2, batch_rows=3)
    found = [r.embedding for r in encoder.encode(df).collect()]
    assert all(abs(math.hypot(*v) - 1) < 1e-6 for v in found)
    # Later batches see the same model: its call count went on.
    assert [round(v[1] / v[0] * (i + 1)) for i, v in enumerate(found)] == [1, 1, 1, 2, 2, 2, 3]


def test_plugin_encoder_of_wrong_size_is_an_error(rows):
    def factory():
        return lambda texts: [[1.0] for _ in texts]

    with pytest.raises(Exception, match="encoder gave"):
        BatchEncoder(factory, dim=2).encode(rows([("a",)], "text string")).collect()


def test_no_chunks_is_an_error(rows):
    with pytest.raises(ValueError):
        embed_chunks(rows([], "chunk_id string, text string"), HashEncoder(16))


def axes(rows):
    names = ["alpha", "bravo", "charlie"]
    return rows([(n[0], n, "s", 0, n, list(map(float, np.eye(3)[i]))) for i, n in enumerate(names)], INDEX)


def ask(rows, vector):
    return rows([("q", vector)], "query_id string, embedding array<float>")


def test_search_on_axes(rows):
    index = axes(rows)
    top = attach_passages(dense_topk(ask(rows, [0.0, 1.0, 0.0]), index, 1), index).collect()
    assert [(r.text, r.score) for r in top] == [("bravo", 1.0)]
    both = dense_topk(ask(rows, [0.9, 0.0, 0.1]), index, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in both] == ["a", "c"]


def test_k_beyond_the_corpus_returns_every_chunk_once(rows):
    found = dense_topk(ask(rows, [1.0, 0.0, 0.0]), axes(rows), 5).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3]


def test_k_must_be_positive_and_dimensions_must_agree(rows):
    with pytest.raises(ValueError):
        dense_topk(ask(rows, [1.0]), axes(rows), 0)
    with pytest.raises(Exception, match="dimensions"):
        dense_topk(ask(rows, [1.0, 2.0]), axes(rows), 1).collect()


def test_ties_follow_corpus_order_by_path_component(rows):
    ids = ["b.md", "a.x", "a/z", "a/b/c"]
    index = rows(
        [(f"{d}#{i}", d, "s", i, "t", [1.0]) for d in ids for i in (10, 2)], INDEX
    ).repartition(3)
    found = dense_topk(ask(rows, [1.0]), index, 8).orderBy("rank").collect()
    expected = [(d, i) for d in sorted(ids, key=lambda d: d.split("/")) for i in (2, 10)]
    assert [(r.doc_id, r.chunk_index) for r in found] == expected


def random_index(rows, n, dim, copies):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((n - copies, dim))
    vectors = np.vstack([base, np.repeat(base[:1], copies, axis=0)]).astype(np.float32)
    return vectors, rows(
        [(f"c{i}", f"d{i:05d}", "s", 0, "t", v.tolist()) for i, v in enumerate(vectors)], INDEX
    )


def brute_force(queries, vectors, k):
    scores = (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.float32)
    return {
        str(i): [f"c{j}" for j in sorted(range(len(vectors)), key=lambda j: (-s[j], j))[:k]]
        for i, s in enumerate(scores)
    }


@pytest.mark.parametrize("k", [1, 7, 400])
def test_all_search_forms_equal_brute_force_even_with_many_copies(rows, k):
    # A third of the index is one vector repeated: ties far beyond k.
    vectors, index = random_index(rows, 300, 8, 100)
    queries = np.vstack([vectors[:5], -vectors[:5], np.zeros((1, 8), np.float32)])
    asked = rows([(str(i), v.tolist()) for i, v in enumerate(queries)], "query_id string, embedding array<float>")
    expected = brute_force(queries, vectors, k)
    forms = {
        "broadcast": {},
        "blocks": {"broadcast_bytes": 0, "query_block": 3, "chunk_block": 40},
        "pilot": {"pilot_fraction": 0.3},
        "pilot blocks": {"pilot_fraction": 0.3, "broadcast_bytes": 0, "query_block": 4, "chunk_block": 64},
    }
    for name, options in forms.items():
        for parts in (1, 5):
            found = {}
            for r in dense_topk(asked, index.repartition(parts), k, **options).orderBy("rank").collect():
                found.setdefault(r.query_id, []).append(r.chunk_id)
            assert found == expected, (name, parts)


def test_no_queries_no_hits(rows):
    empty = rows([], "query_id string, embedding array<float>")
    assert dense_topk(empty, axes(rows), 3).count() == 0
    assert dense_topk(ask(rows, [1.0, 0.0, 0.0]), axes(rows).where("false"), 3).count() == 0


def test_only_k_rows_per_query_reach_the_shuffle(rows):
    plan = dense_topk(ask(rows, [1.0, 0.0, 0.0]), axes(rows), 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_passages_are_fetched_the_same_both_ways(rows):
    index = axes(rows)
    hits = dense_topk(ask(rows, [0.2, 0.9, 0.1]), index, 2)
    small, large = (attach_passages(hits, index, n) for n in (2, 10**9))
    columns = sorted(large.columns)
    assert sorted(small.select(columns).collect()) == sorted(large.select(columns).collect())
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()

def test_fit_encode_is_fit_then_encode_with_one_pass_over_the_text(rows, tmp_path):
    chunks = rows([("a", "red red fox"), ("b", "red hen"), ("b", "red hen"), (None, None), ("d", "")], "chunk_id string, text string")
    for some in (chunks, chunks.where("chunk_id = 'none'")):
        fitted, vectors = IdfEncoder(16).fit_encode(some)
        apart = IdfEncoder(16).fit(some)
        assert fitted.rarity == apart.rarity
        expected = apart.encode(some).select("chunk_id", "embedding")
        assert sorted(map(repr, vectors.collect())) == sorted(map(repr, expected.collect()))
        assert "md5" not in vectors._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_hashes_a_token_once_and_buckets_are_those_of_the_expression(rows, monkeypatch):
    texts = ["The the THE fox-1", None, "", "İx KK é9 " + "a" * 100, "fox " * 50]
    df = rows([(i, t) for i, t in enumerate(texts)], "i long, text string")
    hashed = []
    monkeypatch.setattr(vectors, "md5", lambda t, **how: hashed.append(t) or hashlib.md5(t, **how))
    for dim in (7, 16, 256):
        listed = df.orderBy("i").select(token_buckets(F.coalesce("text", F.lit("")), dim), lower_bytes(F.col("text")))
        named, data = zip(*listed.collect())
        labels = bucket_labels(dim)
        hashed.clear()
        found = TokenBuckets(dim).counts(tokens_of(pa.array(map(lambda d: d and bytes(d), data), pa.binary())))
        assert found.tolist() == [[row.count(b) for b in labels] for row in named]
        assert len(hashed) == len(set(hashed))
