"""Corpus folders, labelled JSON lines, the index table and the event log."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citesift.functions.eventlog import event_json
from citesift.operators.contracts import align_vectors, check_aligned, check_index
from citesift.operators.embedding import HashEncoder
from citesift.plans.ingest import build_corpus_index
from citesift.sources import index_store
from citesift.sources.corpus import documents_from_table, read_text_corpus
from citesift.sources.eventlog import append_lines, log_event, read_events
from citesift.sources.index_store import add_to_index, index_exists, read_index, remove_old_versions, write_index
from citesift.sources.labels import RELEVANCE, read_jsonl, relevance_pairs, with_file_order


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "my corpus+x"
    (root / "sub").mkdir(parents=True)
    (root / "keep.md").write_text("  Hello world\n", encoding="utf-8")
    (root / "blank.md").write_text(" \n ", encoding="utf-8")
    (root / "image.png").write_bytes(b"\x89PNG")
    (root / "sub" / "nested.txt").write_text("nested é", encoding="utf-8")
    (root / "sub" / "UPPER.MD").write_text("upper", encoding="utf-8")
    return root


def test_corpus_scan(spark, corpus):
    found = {r.doc_id: (r.source, r.text) for r in read_text_corpus(spark, str(corpus)).collect()}
    assert set(found) == {"keep.md", "sub/nested.txt", "sub/UPPER.MD"}
    assert found["keep.md"] == (str(corpus / "keep.md"), "Hello world")
    assert found["sub/nested.txt"][1] == "nested é"


def test_corpus_scan_by_uri_and_with_slash(spark, corpus):
    for root in (f"file://{corpus}", f"{corpus}/"):
        assert read_text_corpus(spark, root).where("doc_id = 'sub/nested.txt'").count() == 1


def test_missing_corpus_and_bad_bytes_are_errors(spark, tmp_path, corpus):
    with pytest.raises(FileNotFoundError):
        read_text_corpus(spark, str(tmp_path / "nowhere"))
    (corpus / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(PySparkException):
        read_text_corpus(spark, str(corpus)).collect()


def test_documents_from_a_table(rows):
    df = rows([(1, "x", " a "), (2, "y", "  ")], "doc_id bigint, source string, text string")
    assert [tuple(r) for r in documents_from_table(df).collect()] == [("1", "x", "a")]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "labels.jsonl"
    path.write_text('{"query": "a", "relevant_docs": ["x", "y"]}\n\n{"query": "b", "relevant_docs": ["x"]}\n')
    labelled = with_file_order(read_jsonl(spark, str(path), RELEVANCE))
    assert [r.query for r in labelled.orderBy("seq").collect()] == ["a", "b"]
    assert relevance_pairs(labelled).count() == 3
    path.write_text('{"query": "a", broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_jsonl(spark, str(path), RELEVANCE).collect()


def test_ingest_saves_a_checked_index_and_can_be_repeated(spark, corpus, tmp_path):
    path, events = str(tmp_path / "deep" / "index"), str(tmp_path / "events")
    first = build_corpus_index(spark, str(corpus), HashEncoder(16), path, events_path=events)
    ids = sorted(r.chunk_id for r in first.collect())
    again = build_corpus_index(spark, str(corpus), HashEncoder(16), path)
    assert sorted(r.chunk_id for r in again.collect()) == ids
    logged = json.loads(spark.read.text(events).first().value)
    assert (logged["component"], logged["event"], logged["n_chunks"]) == ("ingest", "index_built", 3)


def test_empty_corpus_is_an_error(spark, tmp_path):
    root = tmp_path / "empty"
    root.mkdir()
    (root / "blank.md").write_text("")
    with pytest.raises(ValueError):
        build_corpus_index(spark, str(root), HashEncoder(16), str(tmp_path / "index"))


def index_rows(rows, entries):
    return rows([(i, "d", "s", 0, "t", v) for i, v in entries],
                "chunk_id string, doc_id string, source string, chunk_index int, text string, embedding array<float>")


BROKEN = {
    "vector missing": [("a", [1.0]), ("b", None)],
    "two dimensions": [("a", [1.0]), ("b", [1.0, 0.0])],
    "id twice": [("a", [1.0]), ("a", [0.0])],
}


@pytest.mark.parametrize("name", BROKEN)
def test_full_index_check(rows, name):
    with pytest.raises(ValueError):
        check_index(index_rows(rows, BROKEN[name]))


@pytest.mark.parametrize("name", ["vector missing", "two dimensions"])
def test_broken_indexes_are_refused_on_load(spark, rows, tmp_path, name):
    write_index(index_rows(rows, BROKEN[name]), str(tmp_path / "i"))
    with pytest.raises(ValueError):
        read_index(spark, str(tmp_path / "i"))


def test_an_index_with_rows_added_or_lost_is_refused(spark, rows, tmp_path):
    path = str(tmp_path / "i")
    index = index_rows(rows, [("a", [1.0]), ("b", [0.0])])
    write_index(index, path)
    assert read_index(spark, path).count() == 2
    index.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="were saved"):
        read_index(spark, path)


def ids_of(index):
    return sorted(r.chunk_id for r in index.collect())


@pytest.mark.parametrize("broken", ["files", "manifest"])
def test_a_write_that_breaks_off_leaves_the_index(spark, rows, tmp_path, monkeypatch, broken):
    path = str(tmp_path / "i")
    write_index(index_rows(rows, [("a", [1.0])]), path)
    opened = read_index(spark, path)
    new = index_rows(rows, [("b", [1.0]), ("c", [1.0])])
    with monkeypatch.context() as m:
        if broken == "files":
            fail = F.when(F.col("chunk_id") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("source"))
            attempt = new.withColumn("source", fail.cast("string"))
        else:
            def lost(*_):
                raise RuntimeError("lost")

            m.setattr(index_store, "_append", lost)
            attempt = new
        with pytest.raises(Exception, match="lost"):
            write_index(attempt, path)
        with pytest.raises(Exception, match="lost"):
            add_to_index(attempt, path, "x")
    assert ids_of(read_index(spark, path)) == ["a"]
    add_to_index(new, path, "x")
    assert ids_of(read_index(spark, path)) == ["a", "b", "c"]
    write_index(new, path)
    assert ids_of(read_index(spark, path)) == ["b", "c"]
    assert ids_of(opened) == ["a"]
    assert len(remove_old_versions(spark, path)) == 2
    assert ids_of(read_index(spark, path)) == ["b", "c"]


def test_a_first_write_that_breaks_off_is_no_index(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    assert not index_exists(spark, path)
    with monkeypatch.context() as m:
        m.setattr(index_store, "_append", lambda *_: None)
        write_index(index_rows(rows, [("a", [1.0])]), path)
    assert not index_exists(spark, path)
    with pytest.raises(ValueError, match="no recorded facts"):
        read_index(spark, path)


def test_rows_are_added_once_and_checked(spark, rows, tmp_path):
    path = str(tmp_path / "i")
    for name, entries in [("1", [("a", [1.0])]), ("2", []), ("1", [("z", [1.0])]), ("3", [("b", [0.5])])]:
        add_to_index(index_rows(rows, entries), path, name)
    assert ids_of(read_index(spark, path)) == ["a", "b"]
    add_to_index(index_rows(rows, [("c", [1.0, 0.0])]), path, "4")
    with pytest.raises(ValueError, match="dimensions"):
        read_index(spark, path)


def test_alignment(rows):
    chunks = rows([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = rows([("b", [2.0]), ("a", [1.0])], "chunk_id string, embedding array<float>")
    check_aligned(chunks, vectors)
    found = {r.chunk_id: r.embedding[0] for r in align_vectors(chunks, vectors).collect()}
    assert found == {"a": 1.0, "b": 2.0}
    with pytest.raises(ValueError):
        check_aligned(chunks, vectors.where("chunk_id = 'a'"))
    check_index(align_vectors(chunks, vectors))
    for one, other in ((chunks, vectors.limit(1)), (chunks.limit(1), vectors)):
        with pytest.raises(Exception, match="no partner"):
            align_vectors(one, other).collect()


def test_event_lines_keep_types_and_protect_the_spine(spark):
    line = event_json(
        F.lit("serve"),
        F.lit("ask"),
        fields={"latency_ms": F.lit(2.5), "refused": F.lit(False), "ts": F.lit("hacked"), "gone": F.lit(None)},
        open_fields=F.from_json(F.lit('{"level": "hacked", "k": 3, "name": "x"}'), "map<string, variant>"),
    )
    event = json.loads(spark.range(1).select(line).first()[0])
    assert list(event)[:4] == ["ts", "level", "component", "event"]
    assert event["ts"] != "hacked" and event["ts"].endswith("+00:00")
    assert event["level"] == "INFO"
    assert {k: event[k] for k in ("latency_ms", "refused", "k", "name")} == {
        "latency_ms": 2.5, "refused": False, "k": 3, "name": "x"}
    assert "gone" not in event


def test_event_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    log_event(spark, path, "eval", "grounding_skipped", "WARNING", reason="none")
    log_event(spark, path, "eval", "plain")
    append_lines(spark.range(1).select(event_json(F.lit("a"), F.lit("b")).alias("value")), path)
    found = read_events(spark, path, "level string, event string, reason string")
    assert sorted((r.level, r.event) for r in found.collect()) == [
        ("INFO", "b"), ("INFO", "plain"), ("WARNING", "grounding_skipped")]
    with pytest.raises(ValueError):
        log_event(spark, path, "eval", "x", "LOUD")
