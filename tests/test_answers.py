"""Citations, prompts, generators, grounding, the report."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from citesift.functions import prompts as P
from citesift.functions.citations import extract_citations, grounding_score
from citesift.operators.contracts import check_depths
from citesift.operators.evaluation import RunConfig, build_report
from citesift.operators.generation import BatchGenerator, ExtractiveGenerator, build_prompts
from citesift.operators.grounding import answer_and_score, grounding_summary, with_passages
from citesift.sources.reports import write_report

A, B, C = "a.md#0-aaaaaaaaaaaa", "b.md#1-bbbbbbbbbbbb", "c.md#2-cccccccccccc"


def cited(spark, answer):
    return spark.range(1).select(extract_citations(F.lit(answer))).first()[0]


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        (f"Uses it [{A}].", [A]),
        (f"[{A}; {B},{C}]", [A, B, C]),
        (f"[{B}] then [{A} {B}]", [B, A, B]),
        ("See [#overview] and [a.md#] and [label].", []),
        ("[a.md#0] has no hash", ["a.md#0"]),
        (f"[[{A}]] and [x [{B}] y]", [A, B]),
        ("none", []),
        ("", []),
    ],
)
def test_citations(spark, answer, expected):
    assert cited(spark, answer) == expected


def test_citations_equal_plain_python_on_random_answers(rows):
    rng = random.Random(8)
    pieces = ["[", "]", "a#1", "#", "b", ",", ";", " ", "\n", " ", "c#", "x#y"]
    answers = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = rows([(i, a) for i, a in enumerate(answers)], "i int, a string")
    for r in df.select("i", "a", extract_citations(F.col("a")).alias("c")).collect():
        tokens = [t for body in re.findall(r"\[([^\[\]]+)\]", r.a) for t in re.split(r"[\s,;]+", body)]
        assert r.c == [t for t in tokens if "#" in t[1:-1] and t[0] != "#" and t[-1] != "#"]


@pytest.mark.parametrize(
    ("answer", "provided", "expected"),
    [
        (f"[{A}, {B}]", [A, B], (True, 1.0, 2)),
        (f"Tea grows on hills [{A}], and so do pines [none.txt#2-0123456789ab].", [A, B], (True, 0.5, 2)),
        ("Pears ripen late [a.md#0], they say.", [A], (True, 0.0, 1)),
        ("Nothing is known about this.", [A], (False, 1.0, 0)),
        (None, [A], (False, 0.0, 0)),
        (f"It rained for days [{A}].", [], (True, 0.0, 1)),
        (f"[{A}] [{A}]", [A], (True, 1.0, 2)),
    ],
)
def test_grounding_score(spark, answer, provided, expected):
    ids = F.array(*[F.lit(p) for p in provided]).cast("array<string>")
    found = spark.range(1).select(grounding_score(F.lit(answer).cast("string"), ids).alias("g")).first().g
    assert (found.has_citation, found.valid_fraction, found.n_citations) == expected


def ranked(rows):
    return rows(
        [("q", 2, B, "b.md", "src/b.md", "Second."), ("q", 1, A, "a.md", "src/a.md", "First.")],
        "query_id string, rerank_rank int, chunk_id string, doc_id string, source string, text string",
    )


def queries(rows):
    return rows([("q", "How?"), ("none", "Why?")], "query_id string, query string")


def test_prompt_lists_sources_in_rank_order(rows):
    prompts = {r.query_id: r for r in build_prompts(with_passages(queries(rows), ranked(rows))).collect()}
    content = prompts["q"].messages[0].content
    assert content == f"Sources:\n[{A}] First.\n\n[{B}] Second.\n\nQuestion: How?"
    assert prompts["q"].messages[0].role == "user"
    system = prompts["q"].system[0]
    assert system.cache_control.type == "ephemeral" and system.text == P.INSTRUCTION
    assert prompts["none"].messages[0].content == "Sources:\n\n\nQuestion: Why?"


def test_instruction_teaches_ids_that_are_read_back(spark):
    assert cited(spark, P.INSTRUCTION) == [P.INSTRUCTION_EXAMPLE_ID]
    assert re.fullmatch(r"[^#]+#\d+-[0-9a-f]{12}", P.INSTRUCTION_EXAMPLE_ID)


def test_text_blocks(spark):
    blocks = F.from_json(
        F.lit('[{"type":"text","text":"Green "},{"type":"tool_use"},{"type":"text","text":"tea"}]'),
        "array<struct<type:string,text:string>>",
    )
    assert spark.range(1).select(P.join_text_blocks(blocks)).first()[0] == "Green tea"


def test_sources_expose_id_and_source_only(rows):
    passages = with_passages(queries(rows), ranked(rows)).where("query_id = 'q'")
    sources = passages.select(P.source_list(F.col("passages")).alias("s")).first().s
    assert [s.asDict() for s in sources] == [
        {"chunk_id": A, "source": "src/a.md"}, {"chunk_id": B, "source": "src/b.md"}]


def test_plugin_generator_gets_the_prompt_and_its_text_blocks_are_joined(rows):
    def factory():
        def client(model, max_tokens, system, messages):
            assert model == "m" and max_tokens == 1024
            assert system[0]["cache_control"] == {"type": "ephemeral"}
            last = messages[0]["content"].splitlines()[-1]
            return [
                {"type": "text", "text": last + " "},
                {"type": "tool_use"},
                {"type": "text", "text": f"[{A}; {C}]"},
            ]

        return client

    scored = answer_and_score(queries(rows), ranked(rows), BatchGenerator(factory, "m"))
    found = {r.query_id: r for r in scored.collect()}
    assert found["q"].answer == f"Question: How? [{A}; {C}]"
    assert found["q"].valid_fraction == 0.5
    assert (found["none"].valid_fraction, found["none"].n_citations) == (0.0, 2)


def test_generator_errors_are_loud(rows):
    def factory():
        def client(**_):
            raise RuntimeError("no key")

        return client

    with pytest.raises(Exception, match="no key"):
        answer_and_score(queries(rows), ranked(rows), BatchGenerator(factory, "m")).collect()


def test_grounding_is_judged_on_what_the_reranker_kept(rows):
    class CitesBoth:
        def answer(self, prompts):
            return prompts.withColumn("answer", F.lit(f"[{A}] [{B}]"))

    kept = ranked(rows).where("rerank_rank = 1")
    scored = answer_and_score(queries(rows).where("query_id = 'q'"), kept, CitesBoth())
    summary = grounding_summary(scored).first()
    assert tuple(summary) == (0.5, 1.0, 1)


def test_extractive_answers_are_grounded_and_empty_evaluations_raise(rows):
    scored = answer_and_score(queries(rows), ranked(rows), ExtractiveGenerator())
    assert tuple(grounding_summary(scored).first()) == (1.0, 0.5, 2)
    with pytest.raises(Exception, match="no queries"):
        grounding_summary(scored.where("false")).collect()


@pytest.mark.parametrize(("retrieve", "keep"), [(50, 100), (50, 0), (0, 0)])
def test_depth_rule(retrieve, keep):
    with pytest.raises(ValueError):
        check_depths(retrieve, keep)


def report_parts(rows):
    means = "dense_ndcg double, reranked_ndcg double, dense_mrr double, reranked_mrr double, dense_recall double, reranked_recall double"
    per_query = rows(
        [("x", 0, 0.5, 1.0, 0.5, 1.0, 1.0, 1.0, 0.5), ("y", 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)],
        f"query string, seq int, {means}, delta double",
    )
    routing = rows([(0.9, 0.8, {"a": 1.0}, 23)],
                   "holdout_macro_f1 double, holdout_accuracy double, per_class_f1 map<string,double>, n_test bigint")
    return per_query, routing, RunConfig("e", "l", 50, 5, "train", "test", "intents")


def test_report_round_trip_with_explicit_null(rows, tmp_path):
    report = build_report(*report_parts(rows)[:2], None, report_parts(rows)[2])
    write_report(report, str(tmp_path / "deep" / "report"))
    (part,) = (tmp_path / "deep" / "report").glob("part-*.json")
    saved = json.loads(part.read_text())
    assert list(saved) == ["generated_at", "config", "reranker", "intent", "grounding"]
    assert saved["grounding"] is None
    assert set(saved["config"]) == {
        "embed_model", "llm_model", "retrieve_top_k", "rerank_top_k", "eval_train_path", "eval_path", "intents_path"}
    assert saved["reranker"]["reranked_ndcg"] == 1.0 and saved["reranker"]["n_improved"] == 1
    assert saved["reranker"]["per_query_path"] is None and "per_query" not in saved["reranker"]
    assert saved["intent"]["per_class_f1"] == {"a": 1.0}


def test_report_has_one_shape_for_any_number_of_queries(rows, spark):
    per_query, routing, config = report_parts(rows)
    grounding = rows([(1.0, 1.0, 2)], "mean_valid_citation_fraction double, answers_with_citation double, n_queries bigint")
    report = build_report(per_query, routing, grounding, config, "there")
    many = per_query.crossJoin(spark.range(10_000)).drop("id")
    more = build_report(many, routing, grounding, config, "there")
    assert more.schema == report.schema
    assert report.first().grounding.n_queries == 2 and report.first().reranker.per_query_path == "there"
    assert (report.first().reranker.n_queries, more.first().reranker.n_queries) == (2, 20_000)
