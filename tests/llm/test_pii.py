import hashlib
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citesift.llm import pii
from citesift.llm.queries import QUERIES

# The patterns as the task states them; ``pii`` has linear forms of them.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PARTS = ["a@b.co", "x.y+z@q-1.d.e", "_", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112",
         "+1 (555) 010-2030", "+12", "-", " ", "é", "\n", "7", "00", "word", "010.1.1.255"]


def passes(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 9 <= len(number) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
        return 12 <= len(number) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return True


def plain(text):
    spans = []
    for i, kind in enumerate(pii.KINDS):
        spans += [(m.start(), i, m.end()) for m in re.finditer(STATED[kind], text or "") if passes(kind, m[0])]
    return ",".join(f"{pii.KINDS[i]}:{a}:{b}" for a, i, b in sorted(spans))


def spans(df):
    found = pii.personal_data(df)
    return [(r[0], r[1], r[2]) for r in found.select("doc_id", pii.written(F.col("base")), pii.written(F.col("spans"))).collect()]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), min_size=40, max_size=80))
def test_base_spans_equal_the_stated_patterns(docs, texts):
    for i, base, _ in spans(docs(list(enumerate(texts)))):
        assert base == plain(texts[i]), texts[i]


def test_many_hits_and_long_texts_are_placed_right(docs):
    pick = random.Random(2)
    text = " ".join(pick.choice(["é", "1.2.3.4", "a@b.co", "word"]) for _ in range(3000))
    data = [(1, text), (2, "a" * 200_000), (3, "1" * 200_000), (4, "a." * 50_000), (5, "x@" + "a." * 50_000 + "b")]
    # The stated patterns take minutes on the long ones, whose answers are plain.
    known = {1: plain(text), 2: "", 3: "", 4: "", 5: "email:0:100003"}
    assert {i: base for i, base, _ in spans(docs(data))} == known


def test_context_finds_unseen_identifiers(docs):
    data = [(i, f"some words about topic, please reach account u{i}@mail.example now") for i in range(12)]
    data += [(50, "other words here, please reach account KX-7741-AB now"), (51, "model KX-9999-ZZ is on sale")]
    data += [(52, "we saw KX-7741-AB again"), (53, "please reach account +1 555 010 2030 20 or 12345678901")]
    found = {i: (base, every) for i, base, every in spans(docs(data))}
    at = data[12][1].index("KX")
    assert found[50] == ("", f"learned:{at}:{at + 10}")
    assert found[51] == ("", "")
    assert found[52] == ("", "learned:7:17")
    assert all(found[i][0] == found[i][1] for i in range(12))


def test_common_words_are_no_patterns(docs):
    pick = random.Random(6)
    data = []
    for i in range(60):
        words = pick.choices(["the", "the", "of", "and", "cat", "dog", "house"], k=30)
        words.insert(pick.randrange(30), f"u{i}@mail.example")
        data.append((i, " ".join(words)))
    data += [(100, "cat of the AB12CD34EF and the dog")]
    assert {i: every for i, _, every in spans(docs(data))}[100] == ""


def test_edge_rows_and_query(docs, folder):
    data = [(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "1.2.3.4")]
    table = docs(data).withColumn("base", F.lit(1)).withColumn("token", F.lit(2))
    assert sorted(spans(table), key=repr) == sorted(
        [(1, "", ""), (2, "", ""), (3, "email:0:6", "email:0:6"), (3, "email:0:6", "email:0:6"), (None, "ip:0:7", "ip:0:7")], key=repr
    )
    found = QUERIES["op10_bootstrapped_pii"](table.sparkSession, folder(documents=table)).collect()
    for r in found:
        assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()


def test_empty_table_and_no_python(docs):
    assert spans(docs([])) == []
    plan = pii.scan(docs([]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_confidences(edges):
    """The fixed point, by many plain rounds from zero."""
    values = {}
    for pattern, value, seed in edges:
        values.setdefault(pattern, []).append((value, seed))
    values = {p: vs for p, vs in values.items() if sum(seed for _, seed in vs) >= pii.MIN_SEEDS}
    score = dict.fromkeys(values, 0.0)
    for _ in range(400):
        best = {}
        for p, vs in values.items():
            for v, _ in vs:
                best[v] = max(best.get(v, 0.0), score[p])
        of = lambda v: pii.DAMPING * (1.0 if len(v) >= 8 and any(c.isalpha() for c in v) else pii.PLAIN) * best[v]
        score = {p: sum(1.0 if seed else of(v) for v, seed in vs) / (len(vs) + pii.DOUBT) for p, vs in values.items()}
    return score


def test_confidences_equal_plain_rounds(spark):
    pick = random.Random(4)
    edges = []
    for p in range(12):
        edges += [(f"p{p}", f"s{p}x{i}@mail.example", True) for i in range(pick.choice([2, 3, 5, 9, 15]))]
        edges += [(f"p{p}", v, False) for v in pick.sample([f"AB{k}-123{k}" if k % 2 else f"12345{k}" for k in range(10, 40)], pick.randrange(12))]
    found = pii.confidences(spark.createDataFrame(edges, "pattern string, value string, seed boolean"))
    found = {r["pattern"]: r["confidence"] for r in found.collect()}
    expected = plain_confidences(edges)
    assert found.keys() == expected.keys()
    assert all(abs(found[p] - expected[p]) < 2e-3 for p in expected)


def test_unknown_values_lower_a_pattern_smoothly(spark):
    edges = []
    for u in (0, 5, 20, 200):
        edges += [(f"with {u}", f"s{u}x{i}@mail.example", True) for i in range(12)]
        edges += [(f"with {u}", f"KX-{u}-{i:04d}", False) for i in range(u)]
    found = pii.confidences(spark.createDataFrame(edges, "pattern string, value string, seed boolean"))
    found = {r["pattern"]: round(r["confidence"], 3) for r in found.collect()}
    assert found == {f"with {u}": round(12 / (13 + 0.1 * u), 3) for u in (0, 5, 20, 200)}


def test_numbers_and_short_codes_are_found_behind_a_pattern_only(docs):
    data = [(i, f"some words about topic, please reach account u{i}@mail.example now") for i in range(16)]
    values = ["078-05-1120", "555-010-2030", "AB1234", "KX-7741-AB"]
    data += [(50 + k, f"other words, please reach account {v} now") for k, v in enumerate(values)]
    data += [(60 + k, f"sold in lots of {v} pieces") for k, v in enumerate(values)]
    found = {i: every for i, _, every in spans(docs(data))}
    assert all(found[50 + k] == f"learned:34:{34 + len(v)}" for k, v in enumerate(values))
    assert [found[60 + k] for k in range(4)] == ["", "", "", "learned:16:26"]


def test_assigned_values_are_secrets(docs):
    value = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    said = [f'as token = "{value}" here', f"{value}", f'key: {value}"### x', f"API_KEY='{value}';", f"see {value} = 1", "url=https://host/2023/ab12cd34ef56ab78"]
    where = [(12, 52), None, (5, 45), (9, 49), None, None]
    table = docs(list(enumerate(said)))
    found = {i: every for i, _, every in spans(table)}
    kinds = lambda every: [s for s in every.split(",") if s.startswith("secret")]
    assert [kinds(found[i]) for i in range(6)] == [[f"secret:{w[0]}:{w[1]}"] if w else [] for w in where]
