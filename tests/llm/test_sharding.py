from collections import Counter, defaultdict

import pytest

from citesift.llm.sharding import interleave, write_shards
from citesift.llm.queries import QUERIES


def placed(df):
    return sorted((r["shard"], r["slot"], r["doc_id"], r["source"]) for r in df.collect())


@pytest.mark.parametrize("bucket", [7, 50_000])
def test_shards_are_even_gapless_and_mixed(spark, rows, monkeypatch, bucket):
    # 7: every source and slice is cut into many buckets.
    monkeypatch.setattr("citesift.llm.sharding.BUCKET_ROWS", bucket)
    data = [(i, "hot" if i % 3 else "b" if i % 2 else None) for i in range(1003)]
    found = placed(interleave(rows(data, "doc_id long, source string")))
    assert sorted(x[2] for x in found) == list(range(1003))
    sizes = Counter(x[0] for x in found)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert [x[1] for x in found if x[0] == shard] == list(range(n))
    total = Counter(s for _, s in data)
    mix = defaultdict(Counter)
    for shard, _, _, source in found:
        mix[shard][source] += 1
    for counts in mix.values():
        for source, n in total.items():
            assert abs(counts[source] - n / 16) <= 2


def test_buckets_do_not_change_places(rows, monkeypatch):
    data = [(i % 40, f"s{i % 5}") for i in range(400)]  # repeated ids
    one = placed(interleave(rows(data, "doc_id long, source string")))
    monkeypatch.setattr("citesift.llm.sharding.BUCKET_ROWS", 9)
    assert placed(interleave(rows(data, "doc_id long, source string"))) == one


def test_nulls_clashing_columns_and_few_rows(rows):
    data = [(None, None, 7, "x"), (1, "a", None, None), (1, "a", None, None)]
    table = rows(data, "doc_id long, source string, shard int, order string")
    found = interleave(table)
    assert found.columns == ["doc_id", "source", "order", "shard", "slot"]
    assert len({(r["shard"], r["slot"]) for r in found.collect()}) == 3


def test_empty_table(rows):
    assert interleave(rows([], "doc_id long, source string")).count() == 0


def test_files_hold_the_shards(spark, rows, tmp_path):
    data = [(i, f"s{i % 3}", "text") for i in range(50)]
    sharded = interleave(rows(data, "doc_id long, source string, text string"), n_shards=4)
    write_shards(sharded, str(tmp_path / "shards"), rows_per_file=5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert placed(back) == placed(sharded)


def test_query_takes_null_and_long_texts(docs, folder):
    sf = folder(documents=docs([(1, None), (2, ""), (3, "é" * 100_000), (None, "x", None)]))
    found = {r["doc_id"]: r for r in QUERIES["op1_interleaved_shards"](docs([]).sparkSession, sf).collect()}
    assert {k: r["size"] for k, r in found.items()} == {1: 1, 2: 1, 3: 200_001, None: 2}
    assert found[1]["text_crc32"] == 0 and found[None]["text_crc32"] == 0x8CDC1683
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in found.values())
