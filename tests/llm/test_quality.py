import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citesift.llm import quality
from citesift.llm.texts import WordHashes


@given(st.text(alphabet="ab \n|#é\x1c\t", max_size=120))
def test_measures_match_a_plain_count(text):
    words = text.encode().split()
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, r in enumerate(runs) if runs.count(r) > 1 for d in range(3)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    assert quality.measure_text(text.encode(), len(text), WordHashes()) == (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(lines),
    )


def good(n=0):
    return " ".join(f"word{i * (n + 1)}" for i in range(60))


def test_bad_hosts_lose_their_good_documents_too(docs):
    junk = " ".join(f"w{i}#### " for i in range(80))
    data = [(i, junk, "bad.example") for i in range(40)] + [(40, good(1), "bad.example")]
    data += [(100 + i, good(i), f"h{i % 8}.example") for i in range(80)]
    data += [(400 + i, good(i), f"more{i}.example") for i in range(20)]
    kept = {r["doc_id"] for r in quality.keep_good(docs(data)).collect()}
    assert kept == set(range(100, 180)) | set(range(400, 420))


def test_edge_rows_and_clashing_columns(docs):
    data = [(1, None, None), (2, "", "x"), (3, good(), None), (3, good(), None), (4, "a " * 100_000, "x"), (5, "tok " * 20, "y")]
    data += [(i, good(i), "z") for i in range(10, 14)]
    table = docs(data).withColumn("measured", F.lit("kept as it is")).withColumn("host_key", F.lit(1))
    found = quality.keep_good(table)
    assert found.columns == table.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [3, 3, 10, 11, 12, 13]


def test_empty_table(docs):
    assert quality.keep_good(docs([])).count() == 0


@pytest.mark.parametrize(
    "hosts, expected",
    [
        ([], (0.0, 2.0)),
        ([("a", 10, 2)], (0.2, 2.0)),
        ([("a", 10, 2), ("b", 5, 1)], (0.2, 1e6)),
        ([("a", 10, 0), ("b", 10, 10)], (0.5, 2.0)),
    ],
)
def test_prior_in_corner_cases(rows, hosts, expected):
    prior = quality.fit_prior(rows(hosts, "host string, n_docs long, n_failed long"))
    assert prior == pytest.approx(expected)


def test_a_small_host_gets_the_benefit_of_the_doubt(rows):
    hosts = [(f"h{i}", 100, 2) for i in range(30)] + [("small", 2, 1), ("large", 200, 150)]
    found = quality.host_verdicts(rows(hosts, "host string, n_docs long, n_failed long")).collect()
    assert [r["host"] for r in found if r["host_rejected"]] == ["large"]
