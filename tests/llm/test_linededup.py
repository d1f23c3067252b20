import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citesift.llm import linededup
from citesift.llm.linededup import drop_recurring_lines, drop_repeated_lines

OWN = "entirely own words of document number {0} stand here alone {0}x{0}"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def own(i):
    return " ".join(f"{w}{chr(97 + i)}" for w in ("one", "two", "three", "four", "five", "six", "seven"))


def test_variable_fields_are_generalised_and_the_first_copy_stays(docs):
    data = [(i, f"{own(i)}\nPrinted from site on day {i} by user{i}") for i in range(1, 6)]
    found = texts(drop_recurring_lines(docs(data)))
    assert found == {1: data[0][1], **{i: own(i) for i in range(2, 6)}}


def test_words_that_vary_are_fields_too(docs):
    names = ["ann", "bob", "cid", "dora", "eve", "finn"]
    data = [(i, f"{own(i)}\nThis page was last changed by {n} and is free to use by all") for i, n in enumerate(names)]
    found = texts(drop_recurring_lines(docs(data)))
    assert [found[i] for i in range(1, 6)] == [own(i) for i in range(1, 6)]


def test_a_recurring_line_in_a_mixed_leaf(docs):
    # Ten different lines share length and first words; only one of them recurs.
    data = [(i, " ".join(["all", "of", "the"] + [f"{c}{i}{c}" for c in "qrstuvwx"]).replace(str(i), chr(97 + i))) for i in range(10)]
    hot = "all of the usual terms and conditions do apply here"
    data += [(20 + i, f"{own(i)}\n{hot}") for i in range(3)]
    found = texts(drop_recurring_lines(docs(data)))
    assert all(found[d[0]] == d[1] for d in data[:11])
    assert found[21] == own(1) and found[22] == own(2)


def test_copies_of_a_document_are_not_boilerplate(docs):
    text = own(1) + "\n" + own(2)
    data = [(i, text) for i in range(50)]
    assert set(texts(drop_recurring_lines(docs(data))).values()) == {text}


def test_two_texts_are_not_enough_and_short_lines_stay(docs):
    line = "shared by two texts and no more than that"
    data = [(1, f"{own(1)}\n{line}"), (2, f"{own(2)}\n{line}")] + [(i, f"{own(i)}\nthe end of it") for i in range(3, 9)]
    assert texts(drop_recurring_lines(docs(data))) == dict(data)


def test_repeats_inside_a_document_go_together(docs):
    line = "subscribe to our letter for more of this"
    data = [(i, f"{line}\n{own(i)}\n{line}") for i in range(1, 5)]
    found = texts(drop_recurring_lines(docs(data)))
    assert found[1] == data[0][1] and [found[i] for i in (2, 3, 4)] == [own(i) for i in (2, 3, 4)]


def test_edge_rows_and_clashing_columns(docs):
    line = "the very same closing line in many texts"
    data = [(None, f"{own(1)}\n{line}"), (1, None), (2, ""), (3, line), (3, line), (4, f"{line}\n{own(2)}"), (5, "x " * 50_000)]
    table = docs(data).withColumn("gone", F.lit(1)).withColumn("text_key", F.lit(2)).withColumn("leaf", F.lit(3))
    found = drop_recurring_lines(table)
    assert found.columns == table.columns
    got = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr)
    expected = [(None, own(1)), (1, None), (2, ""), (3, line), (3, line), (4, own(2)), (5, "x " * 50_000)]
    assert got == sorted(expected, key=repr)


def test_empty_table_and_no_python(docs):
    found = drop_recurring_lines(docs([]))
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_of_numbers_are_no_template(docs):
    data = [(i, f"{own(i)}\n{i} {i}0 {i}5 12{i} 9 {i}") for i in range(1, 8)]
    assert texts(drop_recurring_lines(docs(data))) == dict(data)


def test_every_template_of_a_leaf_keeps_its_first_document(docs, spark):
    mail, quote = "Please contact us by mail today", "Please contact us for a quote"
    data = [(i, f"{own(i)}\n{mail if i < 4 else quote}") for i in range(1, 7)]
    found = texts(corpus_pipeline.line_dedup(spark, docs(data), ""))
    assert found == {i: text if i in (1, 4) else own(i) for i, text in data}


def test_a_long_line_of_two_texts_stays_in_one(docs, spark):
    passage = " ".join(f"passage{k}" for k in range(60))
    alone = {i: " ".join(f"own{i}x{k}" for k in range(100)) for i in (1, 2, 3)}
    data = [(i, f"{alone[i]}\n{passage}") for i in (1, 2)] + [(3, f"{alone[3]}\nshort line in one text")]
    table = docs(data)
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        table = stage(spark, table, "")
    assert texts(table) == {1: data[0][1], 2: alone[2], 3: data[2][1]}


def test_other_lines_of_a_leaf_take_no_template_away(docs):
    names = ["ann", "bob", "cid", "dora", "eve", "finn"]
    data = [(i, f"{own(i)}\nThis page was last changed by {n} and is free to use by all") for i, n in enumerate(names)]
    for crowd in (0, 40, 300):
        # Some of them have a name in the place of the field, so that it looks constant there.
        more = [
            (100 + k, "This page was " + " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" if c != "d" else names[k % 6] for c in "abcdefghijk"))
            for k in range(crowd)
        ]
        found = texts(drop_recurring_lines(docs(data + more)))
        assert found == {0: data[0][1], **{i: own(i) for i in range(1, 6)}, **dict(more)}


def test_templates_of_a_leaf_do_not_replace_each_other(docs):
    mail, quote = "Please contact us by mail today", "Please contact us for a quote"
    data = [(i, f"{own(i)}\n{mail if i < 4 else quote}") for i in range(1, 7)]
    found = texts(drop_recurring_lines(docs(data)))
    assert found == {i: text if i in (1, 4) else own(i) for i, text in data}


def test_literal_repeats_go_with_digits_and_by_length(docs):
    numbers, long_line, short = "Tel 555 010 2030 22", "Tel +1 555 010 2030 Fax +1 555 010 2031", "All rights reserved."
    data = [(i, f"{own(i)}\n{numbers}") for i in range(1, 4)]
    data += [(i, f"{own(i)}\n{long_line}") for i in (4, 5)]
    data += [(i, f"{own(i)}\n {short}") for i in range(6, 16)]
    found = texts(drop_recurring_lines(docs(data)))
    assert found == {i: text if i in (1, 4, 6) else own(i) for i, text in data}
    assert texts(drop_recurring_lines(docs(data[:-1])))[7] == data[6][1]
    assert texts(drop_recurring_lines(docs(data), long_texts=3))[5] == data[4][1]


def test_joins_beyond_a_broadcast_give_the_same(docs, monkeypatch):
    data = [(i, f"{own(i)}\nPrinted from site on day {i} by user{i}") for i in range(1, 6)]
    monkeypatch.setattr(linededup, "HASH_ROW", 1 << 40)
    assert texts(drop_recurring_lines(docs(data))) == {1: data[0][1], **{i: own(i) for i in range(2, 6)}}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_too_large_for_the_driver_are_not_broadcast(spark, docs, monkeypatch):
    # Hash tables of several hundred thousand rows, which 32 MB of bare hashes allowed, weigh hundreds of MB on the driver.
    n = 400_000
    keys = F.xxhash64("id").alias("key")
    few = linededup.stored(spark.range(n).select(keys, F.col("id").alias("first"), F.lit(1).alias("n_rows")), "few")
    many = spark.range(10).select(keys, "id")
    found = linededup._joined(many, few, ["key"])
    assert "SortMergeJoin" in plan(found)
    assert sorted(r["first"] for r in found.collect()) == list(range(10))

    monkeypatch.setattr(linededup, "SENT_DROPPED", 0)
    data = [(i, f"{own(i)}\nPrinted from site on day {i} by user{i}") for i in range(1, 6)]
    cleaned = drop_recurring_lines(docs(data))
    assert "SortMergeJoin" in plan(cleaned) and "BroadcastHashJoin" not in plan(cleaned)
    assert texts(cleaned) == {1: data[0][1], **{i: own(i) for i in range(2, 6)}}


def test_hot_keys_of_a_large_join_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SENT_BYTES", 4 * linededup.HASH_ROW)
    monkeypatch.setattr(linededup, "HOT_ROWS", 10)
    many = spark.range(1_000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("key"), "id")
    few = spark.range(0, 1_000, 3).select(F.col("id").alias("key"), F.when(F.col("id") == 0, 900).otherwise(1).alias("n_rows"))
    few = linededup.stored(few.withColumn("first", -F.col("key")), "few")
    expected = [(i, 0 if i < 900 else -i if i % 3 == 0 else None) for i in range(1_000)]
    left = linededup._joined(many, few, ["key"], "left")
    assert plan(left).count("SortMergeJoin") == 1 and plan(left).count("BroadcastHashJoin") == 1
    assert left.columns == ["key", "id", "first"]
    assert sorted((r["id"], r["first"]) for r in left.collect()) == expected
    inner = linededup._joined(many, few, ["key"])
    assert sorted((r["id"], r["first"]) for r in inner.collect()) == [e for e in expected if e[1] is not None]


def test_repeated_lines_of_edge_rows(docs):
    line = "ten words or more that two texts have just the same way"
    data = [(None, f"{own(1)}\n{line}"), (1, None), (2, ""), (3, line), (3, line), (4, f"{line}\n{own(2)}"), (5, "x " * 50_000)]
    table = docs(data).withColumn("gone", F.lit(1)).withColumn("text_key", F.lit(2)).withColumn("first", F.lit(3))
    found = drop_repeated_lines(table)
    assert found.columns == table.columns
    expected = [(None, own(1)), (1, None), (2, ""), (3, line), (3, line), (4, own(2)), (5, "x " * 50_000)]
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert drop_repeated_lines(docs([])).count() == 0
