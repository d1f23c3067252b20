"""Words, windows, ids and tokens, against plain Python on hand-made and random texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from citesift.functions import text as X
from citesift.operators.chunking import chunk_documents, replicate_chunks
from citesift.operators.contracts import check_citable, chunk_id_counts
from citesift.operators.numbering import number_rows, sequence_bucket


def windows(rows, text, size, overlap):
    df = rows([("d", "s", text)], "doc_id string, source string, text string")
    return [r.text for r in chunk_documents(df, size, overlap).orderBy("chunk_index").collect()]


def numbered_words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_windows_overlap_and_reach_the_last_word(rows):
    found = windows(rows, numbered_words(100), 40, 10)
    assert found[1].split()[0] == "w30"
    assert found[-1].split()[-1] == "w99"


@pytest.mark.parametrize(("n", "expected"), [(0, 0), (1, 1), (40, 1), (41, 2), (70, 2), (71, 3)])
def test_redundant_last_window_is_dropped(rows, n, expected):
    assert len(windows(rows, numbered_words(n), 40, 10)) == expected


def test_only_one_window_is_dropped_when_overlap_exceeds_step(rows):
    # Starts at 0, 2, .., 10: six windows over 12 words. The last holds words 10-11, all of them
    # in its predecessor; so are others, but only one is dropped.
    assert len(windows(rows, numbered_words(12), 10, 8)) == 5


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (-1, 0), (5, -1), (5, 5), (5, 9)])
def test_bad_window_parameters(size, overlap):
    with pytest.raises(ValueError):
        X.word_windows(F.col("text"), size, overlap)


def plain_windows(text, size, overlap):
    words = text.split()
    step = size - overlap
    starts = list(range(0, len(words), step))
    if len(starts) > 1 and starts[-1] + overlap >= len(words):
        starts = starts[:-1]
    return [" ".join(words[s : s + size]) for s in starts]


def test_windows_equal_plain_python_on_random_texts(spark, rows):
    rng = random.Random(1)
    gaps = [" ", "\n", "\t\t", " ", "  ", "\x1f", "\x85", "　"]
    texts = [
        "".join(rng.choice(gaps) + rng.choice(["a", "bé", "c1"]) for _ in range(rng.randint(0, 90)))
        for _ in range(60)
    ]
    df = rows([(str(i), "s", t) for i, t in enumerate(texts)], "doc_id string, source string, text string")
    for size, overlap in [(20, 5), (10, 8), (5, 0), (7, 6), (1, 0)]:
        found = {}
        for r in chunk_documents(df, size, overlap).collect():
            found.setdefault(int(r.doc_id), {})[r.chunk_index] = r.text
        for i, t in enumerate(texts):
            expected = dict(enumerate(plain_windows(t, size, overlap)))
            assert found.get(i, {}) == expected


def test_whitespace_is_that_of_python(spark):
    spaces = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    assert sorted(X.WHITESPACE_CHARACTERS) == sorted(spaces)
    df = spark.createDataFrame([(c,) for c in spaces], "c string")
    word = F.concat(F.lit("a"), "c", F.lit("b"))
    assert df.where(F.size(X.words(word)) != 2).count() == 0
    assert df.where(X.strip(F.concat("c", F.lit("x"), "c")) != "x").count() == 0


def test_chunk_id_form_and_stability(rows):
    df = rows([("sub/a.md", "s", "one two three")], "doc_id string, source string, text string")
    first = chunk_documents(df, 2, 0).orderBy("chunk_index").collect()
    digest = hashlib.sha1(b"sub/a.md:0:one two").hexdigest()[:12]
    assert first[0].chunk_id == f"sub/a.md#0-{digest}"
    assert [r.chunk_index for r in first] == [0, 1]
    assert first == chunk_documents(df.repartition(3), 2, 0).orderBy("chunk_index").collect()


def test_index_restarts_per_document_and_ids_are_unique(rows):
    df = rows([(d, "s", numbered_words(9)) for d in "ab"], "doc_id string, source string, text string")
    chunks = chunk_documents(df, 3, 0)
    assert sorted((r.doc_id, r.chunk_index) for r in chunks.collect()) == [
        (d, i) for d in "ab" for i in range(3)
    ]
    counts = chunk_id_counts(chunks).first()
    assert (counts.n_rows, counts.n_ids, counts.n_broken_ids) == (6, 6, 0)


def test_ids_that_citations_cannot_carry_are_found(rows):
    check_citable(rows([("a.md#0-abc",)], "chunk_id string"))
    for bad in ["a b.md#0-abc", "a,b#0-abc", "a;b#0-abc", "a[1]#0-abc"]:
        with pytest.raises(ValueError):
            check_citable(rows([(bad,)], "chunk_id string"))


def test_tokens_and_overlap(rows):
    df = rows(
        [("Green Tea graph", "green tea needs water"), ("", "x"), ("!!!", "x"), ("a a b", "B c")],
        "q string, t string",
    )
    found = [r.o for r in df.select(X.lexical_overlap(F.col("q"), F.col("t")).alias("o")).collect()]
    assert found == pytest.approx([2 / 3, 0.0, 0.0, 0.5])
    text = "Déjà-vu: A1b2 a1B2 Straße"
    tokens = df.select(X.token_set(F.lit(text))).first()[0]
    assert sorted(tokens) == sorted(set(re.findall("[a-z0-9]+", text.lower())))


def test_replicas_cycle_through_the_base(rows):
    base = rows([(f"c{i}", "d", "s", i, f"t{i}") for i in range(3)],
                "chunk_id string, doc_id string, source string, chunk_index int, text string")
    numbered = number_rows(
        base, [], [F.col("chunk_index")], sequence_bucket(F.col("chunk_index"))
    ).select("chunk_id", "position")
    copies = replicate_chunks(base, numbered, 3, 7).orderBy("copy").collect()
    assert [r.text for r in copies] == ["t0", "t1", "t2", "t0", "t1", "t2", "t0"]
    assert len({r.chunk_id for r in copies}) == 7
    assert replicate_chunks(base, numbered, 3, 2).count() == 2
