import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citesift.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
TEXT = st.text(alphabet="abthein gor.,\n\t  é☃日▁\x00", max_size=60)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.load())


def toy(scores):
    return pieces.vocabulary("unigram", {p: (s, i) for i, (p, s) in enumerate(scores.items())}, [-1] * 256, 99, [])


@given(TEXT)
def test_round_trip_and_ids_of_the_library(encoder, model, text):
    ids = encoder.encode(text)
    assert pieces.decode_ids(ids, encoder.vocab.spelled) == text
    if pieces.MARK not in text and "\x00" not in text:
        assert ids.tolist() == model.encode(text)


def test_long_text_without_spaces_is_streamed(encoder, model):
    pick = random.Random(4)
    text = "".join(pick.choice(["the", "ing", "é", "x", "ation", "日"]) for _ in range(20_000))
    assert encoder.encode(text).tolist() == model.encode(text)


def test_ids_come_out_before_the_text_ends():
    vocab = toy({"a": -1.0, "ab": -1.5, "b": -1.0, "abc": -2.0, "c": -1.0})
    stream = pieces.Stream(vocab)
    early = [end for _, _, end in stream.search("abcab" * 100)]
    assert early == sorted(early) and early[-1] == 500
    walked = stream.search("abcab" * 100)
    assert next(walked)[2] <= 2 * vocab.longest


@given(st.text(alphabet="abcd", max_size=40), st.integers(0, 5))
def test_unigram_paths_are_the_best(text, seed):
    pick = random.Random(seed)
    scores = {c: -pick.uniform(2, 4) for c in "abc"}
    scores |= {"".join(pick.choices("abcd", k=pick.randint(2, 4))): -pick.uniform(1, 6) for _ in range(12)}
    vocab = toy(scores)
    stream = pieces.Stream(vocab)
    unknown = min(scores.values()) - pieces.UNKNOWN_PENALTY
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            part = text[start:end]
            s = scores.get(part, unknown if end - start == 1 else -np.inf)
            best[end] = max(best[end], best[start] + s)
    path = list(stream.search(text))
    assert "".join(text[a:b] for _, a, b in path) == text
    total = sum(scores.get(text[a:b], unknown) for _, a, b in path)
    assert total == pytest.approx(best[-1])


def test_nothing_remembered_is_needed(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 2)
    text = "the thing and the other thing in the station of nations"
    assert pieces.Encoder(pieces.load()).encode(text).tolist() == model.encode(text)


def test_tables_with_nulls_and_odd_ids(spark, rows):
    data = [(1, None), (2, ""), (3, " "), (4, "a▁b \\n\n"), (4, "a▁b \\n\n"), (5, "lorem " * 40_000)]
    df = rows(data, "doc_id long, text string").withColumn("ids_", F.lit(1))
    coded = df.withColumn("ids", pieces.encoded(spark, F.col("text")))
    back = coded.withColumn("back", pieces.decoded(spark, F.col("ids"))).collect()
    assert all(r["back"] == r["text"] for r in back)
    found = {r["doc_id"]: r["ids"] for r in back}
    assert found[1] is None and found[2] == [] and len(found[3]) == 1
    odd = rows([([None, -5, 10**6, 1, 2],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in odd.select(pieces.decoded(spark, F.col("ids"))).collect()] == ["", None, ""]
    assert df.limit(0).withColumn("ids", pieces.encoded(spark, F.col("text"))).count() == 0


def test_kind_is_read_from_the_model_file():
    with open(pieces.MODEL, "rb") as f:
        assert pieces.algorithm_of(f.read()) == "bpe"
    assert pieces.algorithm_of(b"") == "unigram"
    with pytest.raises(ValueError):
        pieces.algorithm_of(bytes([0x12, 2, 0x18, 3]))


@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=4), min_size=1), st.text(alphabet="abcd", max_size=30), st.integers(0, 9))
def test_endings_are_all_pieces_that_end_at_a_place(found, text, steps):
    ids = {p: i for i, p in enumerate(sorted(found))}
    node = pieces.Endings(ids).root
    node.endings.n_steps = pieces.REMEMBERED - steps
    for end, char in enumerate(text, 1):
        node = node[char]
        assert node.ending == [(ids[text[i:end]], end - i) for i in range(end) if text[i:end] in ids]


def test_a_word_is_remembered_once_whatever_sign_is_behind_it(model):
    encoder = pieces.Encoder(pieces.load())
    text = "station, station. station; ²station? x².5 a.b station_1 (station)"
    assert encoder.encode(text).tolist() == model.encode(text)
    assert [w for w in encoder if w.startswith("▁station")] == ["▁station"]
