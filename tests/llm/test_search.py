import random
import re
from collections import Counter
from math import floor, log

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from check import connect, spark_rows, sql_rows
from citesift.llm import search

QUERY = "op12_pipelined_search"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, best=20):
    """Every document scored for every item."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // n_terms
            gain = {t: floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * n // (1000 * n + 12 * m)) for t, n in bag.items()}
            score = sum(gain.get(t, 0) for t in plain_terms(text))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        rows += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:best])]
    return sorted(rows, key=repr)


@given(st.text(max_size=60))
def test_terms(text):
    text = text.encode("utf-8", "replace").decode()
    found = [w.decode() for words in search.terms_of(text.encode()) for w in words]
    assert found == plain_terms(text)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "x-y", "a_b", "9"]
    odds = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, odds, k=rng.randrange(1, 60)))) for i in range(n)], rng, words


def found_rows(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("ITEM", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    return spark_rows(search.ranked_search(d.repartition(3), i, **options).select("item_id", "rank", "doc_id", "score"))


def rows_of(answer):
    names, rows = answer
    return sorted(((r[names.index("item_id")], r[names.index("rank")], r[names.index("doc_id")], r[names.index("score")]) for r in rows), key=repr)


@pytest.mark.parametrize("owners", [1, 4])
def test_search_equals_scoring_all_documents(spark, monkeypatch, owners):
    docs, rng, words = corpus(300, owners)
    docs += [(400 + i, docs[0][1]) for i in range(60)]  # copies: ties
    docs += [(7, "w1 w1 w2"), (7, "w1 w1 w2"), (None, "w1 w1 w2"), (500, None), (501, ""), (502, " -_- "), (503, "w59 " * 9000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(12)]
    items += [(90, None), (91, "unheard of"), (92, "w1 w1 w1 W1"), (92, "w2"), (None, "w3 w59")]
    monkeypatch.setattr(search, "BLOCK_DOCS", 64)
    monkeypatch.setattr(search, "ITEMS_AT_ONCE", 9)
    assert rows_of(found_rows(spark, docs, items, owners=owners, best=7)) == plain_search(docs, items, 7)


def test_documents_that_cannot_win_are_not_sent_on():
    docs = 100
    gains = {1: ([5, 6, 7], [900, 800, 700]), 2: (list(range(docs)), [10] * docs)}

    def lists(owner):
        def packed(places, values):
            return pa.array(places, pa.int32()).to_numpy().tobytes(), pa.array(values, pa.int64()).to_numpy().tobytes()

        head = packed([1, 2], [900, 10])
        own = packed(*gains[owner])
        return pa.table({"term": pa.array([None, owner], pa.int32()), "places": [head[0], own[0]], "gains": [head[1], own[1]]})

    start = pa.Table.from_pylist(
        [{"block": 0, "item": 0, "terms": [2, 1], "times": [1, 2], "floor": 0, "places": b"", "gains": b""}], search._BUNDLE
    )
    first = next(search.visit(0, lists(1), start, 2))
    assert first["terms"] == [2] and len(first["places"]) == 4 * 2  # 1400 and 10 more are below the second, 1600
    assert first["floor"] == 1600
    last = next(search.visit(0, lists(2), pa.Table.from_pylist([first], search._BUNDLE), 2))
    assert len(last["places"]) == 4 * 2 and last["terms"] == []


def test_empty_tables(spark, docs, rows, folder, tmp_path_factory):
    nothing = rows([], "item_id long, text string")
    assert queries()[QUERY](spark, folder(documents=docs([(1, "a b")]), benchmark=nothing)).count() == 0
    some = rows([(1, "a")], "item_id long, text string")
    assert search.ranked_search(docs([]), some).count() == 0
    assert search.ranked_search(docs([(1, None)]), some).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(queries()[QUERY](spark, sf)) == sql_rows(connect(sf), oracle_sql()[QUERY])
