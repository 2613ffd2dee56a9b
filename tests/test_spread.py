"""The lookup join gives an inner join's rows whatever the keys' sizes."""

import pytest

from conftest import rows
from tidemark.operators import spread


@pytest.mark.parametrize("hot_keys", [1, 4, 10_000])
def test_same_rows_as_a_join(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(spread, "HOT_KEYS", hot_keys)
    monkeypatch.setattr(spread, "HOT_FROM", 5)
    made = [("hot" if i % 3 else f"k{i % 11}", i) for i in range(300)] + [("alone", 999), (None, 1000)]
    df = spark.createDataFrame(made, "k string, id int")
    side = spark.createDataFrame([("hot", 200, "h"), *[(f"k{i}", 9, f"v{i}") for i in range(9)], ("unused", 1, "u")], "k string, n int, v string")
    got = rows(spread.spread_join(df, side, ["k"], "n", ["id"]), "id")
    assert got == rows(df.join(side, "k").select("k", "id", "n", "v"), "id")


def test_no_hot_key_at_all(spark):
    df = spark.range(1000).selectExpr("id % 7 k", "id")
    side = df.groupBy("k").count()
    out = spread.spread_join(df, side, ["k"], "count", ["id"])
    assert out.count() == 1000
