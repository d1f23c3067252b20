"""Tables as streams: one file, or a folder of part files."""

import pytest

from citesift.plans.registry import QUERIES, _stream_of


@pytest.mark.parametrize("files", [0, 1, 3])
def test_a_table_of_part_files_is_streamed_whole(spark, rows, tmp_path, files):
    table = rows([(i, f"e{i}") for i in range(9)], "doc_id long, text string")
    sf = tmp_path / "sf"
    sf.mkdir()
    if files:
        table.repartition(files).write.parquet(str(tmp_path / "written"))
        (tmp_path / "written").rename(sf / "documents.parquet")
    else:
        table.toPandas().to_parquet(sf / "documents.parquet")
    other = rows([(1, "other")], "doc_id long, text string")
    other.toPandas().to_parquet(sf / "labels.parquet")
    stream = _stream_of(spark, str(sf), "documents").writeStream.format("parquet").trigger(availableNow=True)
    stream.option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(table.collect())


def test_an_index_is_streamed_from_part_files(spark, rows, tmp_path):
    docs = rows([(i, "src", " ".join(f"w{j}" for j in range(300))) for i in range(6)], "doc_id long, source string, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    streamed = QUERIES["stream_index_table"](spark, str(tmp_path)).select("chunk_id").collect()
    batch = QUERIES["chunk_ids"](spark, str(tmp_path)).collect()
    assert sorted(streamed) == sorted(batch) and len(batch) == 12
