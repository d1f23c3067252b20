"""Whole jobs: ask, train, evaluate, their streams, and the latency statistics."""

import datetime as dt
import json
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from citesift.functions.prompts import REFUSAL
from citesift.operators.chunking import chunk_documents
from citesift.operators.embedding import HashEncoder, IdfEncoder
from citesift.operators.features import Bm25Scorer, corpus_stats
from citesift.operators.generation import ExtractiveGenerator
from citesift.operators.latency import latency_summary
from citesift.operators.rerank import LinearRanker
from citesift.operators.routing import OUT_OF_SCOPE, CentroidRouter
from citesift.plans.ask import Assistant, ask_and_log
from citesift.plans.assistant import open_assistant
from citesift.plans.evaluate import evaluate_models
from citesift.plans.ingest import index_documents
from citesift.plans.train import Paths, train_models
from citesift.sources import index_store
from citesift.sources.encoders import index_encoder
from citesift.sources.index_store import read_index, record_facts
from citesift.streaming.asks import stream_ask
from citesift.streaming.ingest import stream_index, stream_into_index
from citesift.streaming.rollup import (
    latency_counts,
    read_window_counts,
    rollup,
    stream_latency_counts,
    stream_window_counts,
)

DOCS = {
    "fruit.md": "apples and pears grow on trees in the orchard and taste sweet in autumn",
    "cars.md": "engines and wheels move cars along the road while brakes slow the wheels",
    "music.md": "violins and drums play songs while the singer reads the notes of the song",
    "sea.md": "ships and whales cross the sea while waves roll over the sandy shore",
}
ASKED = [("1", "where do apples grow"), ("2", "joke please joke"), ("3", "how do brakes slow wheels")]


@pytest.fixture(scope="module")
def encoder():
    return HashEncoder(256)


@pytest.fixture
def documents(rows):
    return rows([(d, f"/c/{d}", t) for d, t in DOCS.items()], "doc_id string, source string, text string")


def intent_rows():
    factual = [f"where do {w} grow" for w in ("apples", "pears", "trees", "plums")]
    factual += [f"how do {w} slow wheels" for w in ("brakes", "engines", "roads", "tyres")]
    summary = [f"summarize the document about {w}" for w in ("apples", "cars", "songs", "sea", "trees", "ships", "drums", "waves")]
    other = [f"joke please {w}" for w in ("joke", "now", "funny", "again", "more", "best", "new", "old")]
    return [(q, "factual") for q in factual] + [(q, "summarize") for q in summary] + [(q, OUT_OF_SCOPE) for q in other]


@pytest.fixture
def assistant(documents, encoder, rows):
    chunks = chunk_documents(documents, 8, 2)
    index = encoder.encode(chunks).persist()
    labelled = encoder.encode(rows(intent_rows(), "query string, intent string"), "query")
    return Assistant(
        index=index,
        encoder=encoder,
        router=CentroidRouter.fit(labelled),
        scorer=Bm25Scorer.from_stats(*corpus_stats(chunks)),
        ranker=LinearRanker(),
        generator=ExtractiveGenerator(),
        retrieve_top_k=4,
        rerank_top_k=2,
    )


def test_ask_refuses_first_and_answers_the_rest(assistant, rows):
    found = {r.query_id: r for r in assistant.ask(rows(ASKED, "query_id string, query string")).collect()}
    assert found["2"].intent == OUT_OF_SCOPE
    assert (found["2"].answer, found["2"].sources) == (REFUSAL, [])
    assert found["1"].sources[0].source == "/c/fruit.md"
    assert found["3"].sources[0].source == "/c/cars.md"
    assert len(found["1"].sources) == 2
    assert all(f"[{s.chunk_id}]" in found["1"].answer for s in found["1"].sources)


def test_refused_queries_reach_neither_search_nor_generator(assistant, rows):
    class Failing:
        def answer(self, prompts):
            bad = F.when(F.col("query").contains("joke"), F.raise_error(F.lit("was asked"))).otherwise("ok")
            return prompts.withColumn("answer", bad)

    assistant.generator = Failing()
    plan = assistant.ask(rows(ASKED, "query_id string, query string"))
    assert plan.where("answer = 'ok'").count() == 2
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    # Every branch reads the routed queries through its own intent filter, below any join.
    filters = [line for line in optimized.splitlines() if "Filter" in line and OUT_OF_SCOPE in line]
    assert len(filters) >= 2


def test_ask_on_an_empty_index_still_answers(assistant, rows):
    assistant.index = assistant.index.where("false")
    found = {r.query_id: r for r in assistant.ask(rows(ASKED, "query_id string, query string")).collect()}
    assert (found["1"].answer, found["1"].sources) == ("", [])


def test_query_stream_equals_batch(assistant, rows, spark, tmp_path):
    batch = rows(ASKED, "query_id string, query string")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("answers", "events", "checkpoint")]
    stream_ask(stream, assistant, *paths).awaitTermination()
    stream_ask(stream, assistant, *paths).awaitTermination()  # a restart adds nothing
    columns = ["query_id", "intent", "answer", "sources"]
    streamed = spark.read.parquet(paths[0]).select(columns)
    assert sorted(streamed.collect()) == sorted(assistant.ask(batch).select(columns).collect())
    events = [json.loads(r.value) for r in spark.read.text(paths[1]).collect()]
    assert len(events) == 3
    spine = {"ts", "level", "component", "event", "intent", "confidence", "refused", "latency_ms"}
    for e in events:
        assert set(e) == (spine if e["refused"] else spine | {"n_sources"})
        assert e["latency_ms"] > 0 and 0 < e["confidence"] <= 1


@pytest.mark.parametrize("event_time", [None, "at"])
def test_query_stream_answers_an_id_once(assistant, rows, spark, tmp_path, event_time):
    schema = "query_id string, query string, at timestamp"
    stamp = dt.datetime(2024, 1, 1)
    source = str(tmp_path / "in")
    paths = [str(tmp_path / p) for p in ("answers", "events", "checkpoint")]
    # Equal ids in one batch, then, after a restart, ids of an earlier batch.
    for ids in (["1", "1", "3"], ["3", "2", "2"]):
        texts = dict(ASKED)
        rows([(i, texts[i], stamp) for i in ids], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_ask(stream, assistant, *paths, event_time=event_time).awaitTermination()
    assert sorted(r.query_id for r in spark.read.parquet(paths[0]).collect()) == ["1", "2", "3"]
    assert spark.read.text(paths[1]).count() == 3


def test_ingest_refuses_ids_that_a_citation_cannot_carry(rows, encoder, tmp_path):
    broken = rows([("a]b.md", "/c/a]b.md", "some words of a text")], "doc_id string, source string, text string")
    with pytest.raises(ValueError, match="citation"):
        index_documents(broken, encoder, str(tmp_path / "index"))


def test_document_stream_equals_batch(documents, encoder, spark, tmp_path):
    documents.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "index")
    stream_index(stream, encoder, out, str(tmp_path / "c"), 8, 2).awaitTermination()
    with pytest.raises(ValueError, match="no recorded facts"):
        read_index(spark, out)
    record_facts(spark, out)
    streamed = read_index(spark, out).orderBy("chunk_id").collect()
    batch = encoder.encode(chunk_documents(documents, 8, 2)).orderBy("chunk_id").collect()
    assert streamed == batch


def test_document_stream_commits_every_batch(documents, encoder, spark, tmp_path, monkeypatch):
    documents.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "index"), str(tmp_path / "c")
    append, calls = index_store._append, []

    def breaks_off(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        append(*args)

    monkeypatch.setattr(index_store, "_append", breaks_off)
    with pytest.raises(Exception, match="lost"):
        stream_into_index(stream, encoder, out, checkpoint, 8, 2).awaitTermination()
    part = {tuple(r) for r in read_index(spark, out).select("chunk_id").collect()}
    stream_into_index(stream, encoder, out, checkpoint, 8, 2).awaitTermination()
    whole = read_index(spark, out).orderBy("chunk_id")
    batch = encoder.encode(chunk_documents(documents, 8, 2)).orderBy("chunk_id")
    assert whole.collect() == batch.select(whole.columns).collect()
    assert part < {tuple(r) for r in whole.select("chunk_id").collect()}


def test_idf_weights_are_saved_with_the_index_and_used_by_all(documents, rows, spark, tmp_path):
    path = str(tmp_path / "index")
    index = index_documents(documents, IdfEncoder(256), path, 8, 2)
    chunks = chunk_documents(documents, 8, 2)
    fitted = index_encoder(spark, IdfEncoder(256), path)
    assert fitted.rarity == pytest.approx(IdfEncoder(256).fit(chunks).rarity)
    expected = fitted.encode(chunks).orderBy("chunk_id").collect()
    assert index.select(*expected[0].__fields__).orderBy("chunk_id").collect() == expected
    documents.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(documents.schema).parquet(str(tmp_path / "in"))
    stream_index(stream, fitted, str(tmp_path / "out"), str(tmp_path / "c"), 8, 2).awaitTermination()
    record_facts(spark, str(tmp_path / "out"))
    streamed = read_index(spark, str(tmp_path / "out")).orderBy("chunk_id").collect()
    assert streamed == index.orderBy("chunk_id").collect()
    with pytest.raises(ValueError, match="no saved encoder"):
        index_encoder(spark, IdfEncoder(256), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="16 buckets"):
        index_encoder(spark, IdfEncoder(16), path)
    assert index_encoder(spark, fitted, "nowhere") is fitted


def test_train_and_evaluate_jobs(spark, encoder, tmp_path):
    (tmp_path / "corpus").mkdir()
    for name, text in DOCS.items():
        (tmp_path / "corpus" / name).write_text(text)

    def jsonl(name, records):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in records))
        return str(tmp_path / name)

    train = [("apples in the orchard", "fruit.md"), ("sweet pears", "fruit.md"), ("wheels of cars", "cars.md"),
             ("singer and song", "music.md"), ("whales in the sea", "sea.md")]
    held_out = [("trees in autumn", "fruit.md"), ("drums and violins", "music.md")]
    paths = Paths(
        corpus=str(tmp_path / "corpus"),
        index=str(tmp_path / "index"),
        relevance_train=jsonl("train.jsonl", [{"query": q, "relevant_docs": [d]} for q, d in train]),
        relevance_eval=jsonl("eval.jsonl", [{"query": q, "relevant_docs": [d]} for q, d in held_out]),
        intents=jsonl("intents.jsonl", [{"query": q, "intent": i} for q, i in intent_rows()]),
        ranker=str(tmp_path / "ranker"),
        router=str(tmp_path / "router"),
        report=str(tmp_path / "report"),
        events=str(tmp_path / "events"),
    )
    same = replace(paths, relevance_eval=paths.relevance_train)
    with pytest.raises(ValueError, match="overlap"):
        train_models(spark, same, encoder, retrieve_top_k=10)
    unknown = jsonl("unknown.jsonl", [{"query": "of no file", "relevant_docs": ["gone.md"]}])
    with pytest.raises(ValueError, match="gone.md"):
        train_models(spark, replace(paths, relevance_eval=unknown), encoder, retrieve_top_k=10)
    with pytest.raises(ValueError, match="vocabulary"):
        train_models(spark, paths, encoder, retrieve_top_k=10, intents=["factual", "summarize"])
    ranker, router = train_models(
        spark, paths, encoder, retrieve_top_k=10, ranker_trials=2, router_trials=2
    )
    assert 0 < ranker.val_ndcg <= 1 and router.cv_f1 > 0.5

    report = evaluate_models(spark, paths, encoder, router.config, retrieve_top_k=10).first()
    assert report.grounding is None and report.reranker.n_queries == 2
    again = evaluate_models(
        spark, paths, encoder, generator=ExtractiveGenerator(), retrieve_top_k=10
    ).first()
    assert tuple(again.grounding) == (1.0, 1.0, 2)
    assert again.config.eval_train_path == paths.relevance_train
    events = [json.loads(r.value) for r in spark.read.text(paths.events).collect()]
    names = [e["event"] for e in events]
    assert {"index_built", "models_trained", "reranker", "intent", "grounding"} < set(names)
    (skipped,) = [e for e in events if e["event"] == "grounding_skipped"]
    assert skipped["level"] == "WARNING"
    (ranking, _) = [e for e in events if e["event"] == "reranker"]
    assert "per_query" not in ranking and ranking["n_queries"] == 2
    assert spark.read.json(f"{paths.report}.per_query").count() == 2

    opened = open_assistant(spark, paths, encoder, ExtractiveGenerator(), retrieve_top_k=10)
    asked = spark.createDataFrame([("1", "apples in the orchard")], "query_id string, query string")
    assert opened.ask(asked).count() == 1
    answers = ask_and_log(opened, asked, str(tmp_path / "answers"), paths.events)
    assert answers.collect() == spark.read.parquet(str(tmp_path / "answers")).collect()
    events = [json.loads(r.value) for r in spark.read.text(paths.events).collect()]
    (event,) = [e for e in events if e["event"] == "ask"]
    assert event["latency_ms"] > 0 and event["component"] == "serve"
    with pytest.raises(ValueError, match="different ids"):
        opened.ask(asked.union(asked).union(asked).union(asked)).count()


@pytest.mark.parametrize("range_rows", [200_000, 3])
def test_percentiles_equal_numpy(rows, monkeypatch, range_rows):
    monkeypatch.setattr("citesift.operators.latency.RANGE_ROWS", range_rows)
    rng = random.Random(6)
    groups = {
        "one": [7.0],
        "two": [1.0, 10.0],
        "ties": [5.0] * 500 + [6.0],
        "wide": [round(rng.lognormvariate(1, 2), 2) for _ in range(3000)],
        "few": [float(rng.randint(0, 3)) for _ in range(400)],
        None: [1.0, None, 3.0, 5.0],
    }
    df = rows([(g, v) for g, vs in groups.items() for v in vs], "g string, latency_ms double").repartition(5)
    found = {r.g: r for r in latency_summary(df, ["g"]).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        r, vs = found[g], [v for v in vs if v is not None]
        assert (r.n, r.mean) == (len(vs), pytest.approx(np.mean(vs)))
        assert (r.p50, r.p95) == tuple(pytest.approx(x) for x in np.percentile(vs, [50, 95]))


def test_groups_without_any_latency_stay(rows):
    df = rows([(None, None), ("a", None), ("a", 2.0)], "g string, latency_ms double")
    found = {r.g: (r.n, r.p50, r.mean) for r in latency_summary(df, ["g"]).collect()}
    assert found == {None: (0, None, None), "a": (1, 2.0, 2.0)}


def served(rows, events):
    return rows(events, "ts timestamp, intent string, refused boolean, latency_ms double")


def test_event_rollup_stream_equals_batch_and_drops_late_rows(rows, spark, tmp_path):
    day = dt.datetime(2024, 1, 1)

    def at(hours, intent="factual", refused=False, ms=1.0):
        return (day + dt.timedelta(hours=hours), intent, refused, ms)

    first = [at(20, ms=3.0), at(1, ms=1.0), at(26), at(2, OUT_OF_SCOPE, True, 0.5)]
    second = [at(3, ms=99.0), at(50), at(75)]  # the 3 o'clock row arrives a day late
    for i, part in enumerate((first, second)):
        served(rows, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        stream = (
            spark.readStream.schema("ts timestamp, intent string, refused boolean, latency_ms double")
            .option("recursiveFileLookup", True)
            .parquet(str(tmp_path / "in"))
        )
        stream_latency_counts(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    found = sorted(rollup(spark.read.parquet(str(tmp_path / "out"))).collect())
    on_time = first + second[1:]
    closed = served(rows, on_time).where(F.col("ts") < F.lit(day + dt.timedelta(days=3)))
    assert found == sorted(rollup(latency_counts(closed)).collect())
    by = {(r.window_start.day, r.intent): r for r in found}
    assert by[1, "factual"].p50 == 2.0 and by[1, "factual"].n == 2
    assert by[1, OUT_OF_SCOPE].refusal_rate == 1.0


def test_window_counts_hold_open_windows_and_tell_late_rows(rows, spark, tmp_path):
    day = dt.datetime(2024, 1, 1)

    def at(hours, ms=1.0):
        return (None if hours is None else day + dt.timedelta(hours=hours), "factual", False, ms)

    parts = [[at(20, 3.0), at(26), at(1, None)], [at(3, 99.0), at(50), at(25, 7.0), at(None)], [at(25, 8.0)], []]
    for i, part in enumerate(parts):
        served(rows, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        stream = (
            spark.readStream.schema("ts timestamp, intent string, refused boolean, latency_ms double")
            .option("recursiveFileLookup", True)
            .parquet(str(tmp_path / "in"))
        )
        stream_window_counts(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        so_far = served(rows, [r for p in parts[: i + 1] for r in p])
        found = rollup(read_window_counts(spark, str(tmp_path / "out")))
        assert sorted(found.collect()) == sorted(rollup(latency_counts(so_far)).collect())
    late = read_window_counts(spark, str(tmp_path / "out"), late=True).collect()
    # 26 o'clock closes the first day for the second batch; 50 o'clock the second day for the third.
    assert sorted((r.window_start.day, r.latency_ms, r.n) for r in late) == [(1, 99.0, 1), (2, 8.0, 1)]
    punctual = read_window_counts(spark, str(tmp_path / "out"), late=False)
    assert punctual.agg(F.sum("n")).first()[0] == 5


def test_a_batch_that_is_run_again_counts_once(rows, spark, tmp_path):
    served(rows, [(dt.datetime(2024, 1, 1), "a", False, 1.0)]).write.parquet(str(tmp_path / "in"))
    for run in ("first", "again"):  # a lost checkpoint gives the same batch number again
        stream = spark.readStream.schema("ts timestamp, intent string, refused boolean, latency_ms double")
        stream = stream.parquet(str(tmp_path / "in"))
        stream_window_counts(stream, str(tmp_path / "out"), str(tmp_path / run)).awaitTermination()
    assert [r.n for r in read_window_counts(spark, str(tmp_path / "out")).collect()] == [1]
