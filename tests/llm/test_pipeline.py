import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import connect, spark_rows, sql_rows

SMOKE = "/root/testdata/sf0.001"
NUMBERED = ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "op11_", "op12_", "op13_"]


def own(i):
    return " ".join(f"word{i}x{k}" for k in range(60))


@pytest.fixture
def small(docs, rows, folder):
    line = "one closing line that very many texts do share"
    data = [(i, f"{own(i)}\n{line}") for i in range(6)]
    data += [(10, own(50)), (11, own(50)), (12, own(50) + " more"), (13, "too short"), (14, None), (15, "spam " * 90)]
    labels = rows([(i, 1, 0) for i in range(6)] + [(None, 1, 0), (15, 0, 0)], "doc_id long, quality int, toxic int")
    return folder(documents=docs(data).withColumn("extra", F.lit(1)), labels=labels)


def test_every_operator_and_the_pipeline_are_registered():
    names = list(queries())
    assert all(sum(n.startswith(p) for n in names) == 1 for p in NUMBERED)
    assert "pipeline" in names and set(oracle_sql()) <= set(names)


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns
        counts.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
        if name == "line_dedup":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert "closing" in texts[0] and not any("closing" in texts[i] for i in range(1, 6))
    assert counts[0] == counts[1] == [*range(6), 10, 11, 12]
    assert counts[2] == [*range(6), 10]
    assert set(counts[3]) <= set(counts[2])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert all(r["exact"] for r in last)


def test_run_is_the_stages_in_a_row(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.columns == ["doc_id", "n_ids", "ids", "exact"]
    assert {r["doc_id"] for r in found.collect()} <= {*range(6), 10}


def test_empty_tables(spark, docs, rows, folder):
    sf = folder(documents=docs([]), labels=rows([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf).count() == 0


@pytest.mark.parametrize("name", ["op1_interleaved_shards", "op3_template_lines", "op4_prefix_targets", "op9_host_rules"])
def test_queries_equal_their_sql(spark, name):
    assert spark_rows(queries()[name](spark, SMOKE)) == sql_rows(connect(SMOKE), oracle_sql()[name])
