"""The rows of each group that come first in a hash order, against a plain sort."""

import pytest
from pyspark.sql import functions as F

from citesift.llm import samples
from citesift.llm.samples import first_rows


@pytest.mark.parametrize(("margin", "slack"), [(2, 64), (0, 0.01)])
def test_first_rows_equal_a_plain_sort(rows, spark, monkeypatch, margin, slack):
    # The second setting starts with bounds far too low, which are raised.
    monkeypatch.setattr(samples, "MARGIN", margin)
    monkeypatch.setattr(samples, "SLACK", slack)
    data = [("hot", i) for i in range(3000)] + [("few", i) for i in range(7)] + [("ties", 1)] * 40 + [(None, 1)]
    table = rows(data, "g string, id long")
    order = F.xxhash64(F.col("id").cast("string"))
    wanted = {"hot": 50, "few": 50, "ties": 5, "none": 3}
    sizes = {"hot": 3000, "few": 7, "ties": 40, "none": 0}
    found = sorted(tuple(r) for r in first_rows(table, "g", order, "id", wanted, sizes).collect())
    by_hash = sorted((r.h, r.id) for r in spark.range(3000).select("id", order.alias("h")).collect())
    expected = [("hot", i) for _, i in by_hash[:50]] + [("few", i) for i in range(7)] + [("ties", 1)] * 5
    assert found == sorted(expected)


def test_few_rows_of_a_hot_group_reach_the_window(rows):
    table = rows([("hot", i) for i in range(20000)], "g string, id long")
    order = F.xxhash64(F.col("id").cast("string"))
    share = (2 * 100 + 64) / 20000
    below = table.where(order < F.lit(samples._bound(share))).count()
    assert 150 < below < 400
    assert first_rows(table, "g", order, "id", {"hot": 100}, {"hot": 20000}).count() == 100


def test_no_groups(rows):
    table = rows([], "g string, id long")
    assert first_rows(table, "g", F.xxhash64("id"), "id", {}, {}).count() == 0
