import numpy as np
import pytest
from pyspark.sql import functions as F

from citesift.llm import gru, toxicity
from citesift.llm.frames import text_bytes

BAD = [b"nastyword", b"uglyterm", b"vilephrase"]


def sample(n, seed=0):
    """Texts of a common vocabulary; label 1 has bad words with some ending."""
    pick = np.random.default_rng(99)
    words = [bytes(pick.choice(list(b"aeioubcdlmnrst"), pick.integers(2, 8)).tolist()) for _ in range(300)]
    pick = np.random.default_rng(seed)
    texts, labels = [], np.arange(n) % 2
    for label in labels:
        text = [words[i] for i in pick.integers(0, 300, pick.integers(20, 120))]
        for _ in range(2 * label):
            text[pick.integers(0, len(text))] = BAD[pick.integers(0, 3)] + words[pick.integers(0, 300)]
        texts.append(b" ".join(text))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*sample(1000))


def test_gradients_match_differences():
    model = gru.Model(*[p.astype(np.float64) for p in gru.initial(3)])
    pick = np.random.default_rng(0)
    words = [b"idiot", b"the", b"a", b"lowei", b"of"]
    ids = pick.integers(1, 6, (3, 6))
    ids[1, 4:] = 0
    target, weight = np.array([1.0, 0, 1]), np.ones(3)
    _, found = gru.gradients(model, words, ids, target, weight)
    for name in model._fields:
        p, g = getattr(model, name), getattr(found, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = p[at], []
        for e in (1e-3, -1e-3):
            p[at] = old + e
            losses.append(gru.gradients(model, words, ids, target, weight)[0])
        p[at] = old
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[at], rel=1e-3, abs=1e-6), name


def test_held_out_texts(model):
    held, truth = sample(200, seed=1)
    predicted = toxicity.Scorer(model).highest(held) > np.log(0.3 / 0.7)
    assert (predicted == truth).mean() >= 0.9


@pytest.mark.parametrize("n", [0, 1, 16, 17, 32, 33, 48, 49, 200])
def test_windows_cover_every_word(n):
    windows = toxicity.cut(np.arange(1, n + 1, dtype=np.int32)) if n else []
    assert set(np.concatenate([*windows, [0]])) - {0} == set(range(1, n + 1))


def test_one_word_anywhere_in_a_long_text_counts(model):
    texts, _ = sample(2)
    clean = texts[0].split()
    scorer = toxicity.Scorer(model)
    long = clean * 2000
    base = scorer.highest([b" ".join(long)])[0]
    for at in (0, 5, len(long) // 2, len(long) - 1):
        changed = list(long)
        changed[at] = BAD[0]
        assert scorer.highest([b" ".join(changed)])[0] > max(0, base)


def test_scores_do_not_depend_on_neighbours_or_slices(model, monkeypatch):
    texts, _ = sample(60, seed=9)
    texts += [b"", b" \n", b"one", BAD[0]]
    alone = np.array([toxicity.Scorer(model).highest([t])[0] for t in texts])
    monkeypatch.setattr(toxicity, "BATCH_WINDOWS", 3)
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 20)
    monkeypatch.setattr("citesift.llm.toxicity.slices", lambda data: [data[: len(data) // 2 + data[len(data) // 2 :].find(b" ")], data[len(data) // 2 + data[len(data) // 2 :].find(b" ") :]] if b" " in data[len(data) // 2 :] else [data])
    together = toxicity.Scorer(model).highest(texts)
    assert np.allclose(alone, together, atol=1e-4)
    assert np.isneginf(alone[60:62]).all() and np.isfinite(alone[62:]).all()


def test_tables_with_nulls_and_labels_of_one_kind(docs, rows):
    table = docs([(1, None), (2, ""), (3, "fine words"), (3, "fine words"), (None, "no id")]).withColumn("score_", F.lit(1))
    labels = rows([(3, 0), (None, 1), (2, None), (99, 1)], "doc_id long, label int")
    model = toxicity.trained(table, labels)
    found = table.withColumn("score", toxicity.scores(table.sparkSession, model, text_bytes("text"))).collect()
    assert [r["score"] for r in found] == pytest.approx([0, 0, 0, 0, 0], abs=1e-6)
    empty = docs([])
    model = toxicity.trained(empty, labels)
    assert empty.withColumn("score", toxicity.scores(table.sparkSession, model, text_bytes("text"))).count() == 0
