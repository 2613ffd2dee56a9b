"""Ranks, quantiles, samples and splits against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import aggregates as agg, folds, ranking, reference_dates as ref


def skewed(spark, n=3000):
    """One group holds a third of the rows, and one value most of its rows."""
    rng = random.Random(3)
    made = [("hot" if i % 3 == 0 else f"g{i % 7}", i, 5.0 if rng.random() < 0.4 else rng.uniform(-10, 10)) for i in range(n)]
    return made, spark.createDataFrame(made, "g string, id int, x double")


def test_ranked_is_the_plain_rank(spark):
    made, df = skewed(spark)
    out = ranking.ranked(df, ["g"], [ranking.hash_key("id"), "id"], ranking.hash_bucket("id"), "pos", "n")
    got = {r["id"]: (r["pos"], r["n"]) for r in out.collect()}
    import hashlib

    for g in {m[0] for m in made}:
        ids = sorted((m[1] for m in made if m[0] == g), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        for pos, i in enumerate(ids, 1):
            assert got[i] == (pos, len(ids))


@pytest.mark.parametrize("bucket_points", [40, 10_000])
def test_quantiles(spark, bucket_points):
    made, df = skewed(spark)
    out = ranking.quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}, bucket_points)
    for r in out.collect():
        want = np.quantile([m[2] for m in made if m[0] == r["g"]], [0.25, 0.5, 0.9])
        assert np.allclose([r["a"], r["b"], r["c"]], want, atol=1e-12)
    whole = ranking.quantiles(df, [], "x", {"q": 0.75}, bucket_points).first()["q"]
    assert abs(whole - np.quantile([m[2] for m in made], 0.75)) < 1e-12


@pytest.mark.parametrize("n", [300, 3000])
def test_buckets_stay_small_as_rows_grow(spark, n):
    points = skewed(spark, n)[1].groupBy("g", "x").count()
    dealt = ranking._with_buckets(points, ["g"], "x", 50).groupBy("_bucket").count().collect()
    assert max(r["count"] for r in dealt) <= 100


def test_key_positions(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("zz",), ("za",)], "k string")
    assert rows(ranking.key_positions(df, "k"), "k") == [("a", 1), ("b", 2), ("za", 3), ("zz", 4)]
    nums = spark.createDataFrame([(i * 3 % 101,) for i in range(101)], "k bigint")
    assert rows(ranking.key_positions(nums, "k"), "k") == [(i, i + 1) for i in range(101)]


def test_samples_and_splits_are_exact(spark):
    made, df = skewed(spark)
    smallest = min(sum(m[0] == g for m in made) for g in {m[0] for m in made})
    counts = ranking.balanced_sample(df, "g", "id").groupBy("g").count().collect()
    assert {r["count"] for r in counts} == {smallest}
    for r in ranking.split(df, "id", 0.1, "g").groupBy("g").agg(F.sum(F.expr("int(split = 'test')")).alias("t"), F.count("*").alias("n")).collect():
        assert r["t"] == -(-r["n"] // 10)
    for r in ranking.folds(df, "id", "g", 5).groupBy("g").pivot("fold", [0, 1, 2, 3, 4]).count().collect():
        sizes = list(r.asDict().values())[1:]
        assert max(sizes) - min(sizes) <= 1


def test_auc_with_ties(spark):
    rng = random.Random(5)
    made = [(rng.randint(0, 1), float(rng.randint(0, 20))) for _ in range(500)]
    out = agg.auc_gini(spark.createDataFrame(made, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in made if y], [s for y, s in made if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(out["auc"] - want) < 1e-12 and abs(out["gini"] - (2 * want - 1)) < 1e-12


def test_metrics_without_hits(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    assert rows(agg.binary_metrics(df, "y", "p")) == [(0.5, 0.0, 0.0, 0.0)]


def news_rows(spark, *made):
    df = spark.createDataFrame(list(made), "company int, published string, news_id string, title string")
    return df.withColumn("published", F.to_timestamp("published"))


def test_titles_join_whole_days(spark):
    df = news_rows(spark, *[(1, f"2020-01-0{1 + i % 2} 00:00:00", f"{i:03d}", f"t{i};") for i in range(50)])
    out = agg.title_texts(df).orderBy("date").collect()
    assert [r["text"] for r in out] == ["".join(f"t{i};" for i in range(50) if i % 2 == day) for day in (0, 1)]


def test_titles_follow_fractions_of_seconds(spark):
    df = news_rows(
        spark, (1, "2020-01-01 00:00:01", "a", "C"), (1, "2020-01-01 00:00:00.5", "a", "B"), (1, "2020-01-01 00:00:00", "a", "A"),
        (2, None, "b", "Y"), (2, None, None, "X"),
    )
    assert {r["company"]: r["text"] for r in agg.title_texts(df).collect()} == {1: "ABC", 2: "XY"}


def test_positions_follow_time_and_put_missing_first(spark):
    df = news_rows(
        spark, (1, "2020-01-01 00:00:01", "a", "d"), (1, "2020-01-01 00:00:00.5", "b", "c"), (1, None, "a", "a"),
        (1, "2020-01-01 00:00:00", None, "b"),
    )
    out = ranking.ranked(df, ["company"], ["published", "news_id"], F.struct("published", F.substring("news_id", 1, 2)))
    assert [r["title"] for r in out.orderBy("pos").collect()] == list("abcd")


def test_date_groups(spark):
    listed = [5, 7, 9, 2, 3, 3, 8, 1, 4, 6, 0]
    df = spark.createDataFrame([(i + 1, d) for i, d in enumerate(listed)], "pos int, d int").select(
        "pos", F.expr("date_add(date'2020-01-01', d)").alias("date")
    )
    want = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2), (3, 3), (4, 1)]
    for chunk in (1, 2, 3, 4, 100):
        out = ref.date_groups(df, chunk=chunk).orderBy("pos")
        assert [(r["group_no"], r["in_group"]) for r in out.collect()] == want


def test_time_folds(spark):
    df = spark.createDataFrame(
        [(f"{y}-05-01",) for y, n in ((2014, 5), (2015, 2), (2016, 4), (2017, 6)) for _ in range(n)], "d string"
    ).select(F.to_date("d").alias("published"))
    out = folds.time_folds(df, min_train=5, min_test=3, max_folds=None)
    assert rows(out.select("test_year", "train_rows", "test_rows", "fold"), "test_year") == [(2016, 7, 4, 1), (2017, 11, 6, 2)]
