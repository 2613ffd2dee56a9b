"""The same rows in one file or three give the same tables."""

import datetime as dt

import pytest

from conftest import rows
from tidemark.session import new_path
from tidemark.streaming import streams

SCHEMA = "id int, ts timestamp, k string, x int"
START = dt.datetime(2024, 1, 1)


def arrive(spark, made, parts):
    folder = new_path(spark, "arrive")
    size = -(-len(made) // parts)
    for p in range(parts):
        spark.createDataFrame(made[p * size:(p + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture(scope="module")
def made():
    return [(i, START + dt.timedelta(hours=7 * i), "ab"[i % 2], i) for i in range(30)]


@pytest.mark.parametrize("parts", [1, 3])
def test_ingest_and_sums(spark, made, parts):
    folder = arrive(spark, made, parts)
    read = lambda: streams.read_table(spark, folder, SCHEMA, 1)
    path = new_path(spark, "in")
    streams.ingest(read(), path, new_path(spark, "c")).awaitTermination()
    assert spark.read.parquet(path).count() == len(made)
    path = new_path(spark, "sums")
    streams.daily_sums(read(), "k", "ts", ["x"], path, new_path(spark, "c")).awaitTermination()
    want = {}
    for _, ts, k, x in made:
        want[(k, ts.date())] = want.get((k, ts.date()), 0) + x
    assert rows(streams.totals(spark, path, "k", ["x"]), "k", "date") == sorted((*key, x) for key, x in want.items())


def test_late_rows_count(spark):
    far = [(i, START + dt.timedelta(days=d), "a", 1) for i, d in enumerate([0, 400, 1, 900, 0])]
    folder, path = arrive(spark, far, 5), new_path(spark, "late")
    streams.daily_sums(streams.read_table(spark, folder, SCHEMA, 1), "k", "ts", ["x"], path, new_path(spark, "c")).awaitTermination()
    assert [r["x"] for r in streams.totals(spark, path, "k", ["x"]).orderBy("date").collect()] == [2, 1, 1, 1]


def test_first_seen_however_far_apart(spark, made):
    far = [(i, START + dt.timedelta(days=d), k, 1) for i, (d, k) in enumerate([(0, "a"), (0, None), (400, "a"), (2, "b"), (4000, "b"), (1, "b"), (9000, None)])]
    for parts in (1, 3, 7):
        folder, path, state = arrive(spark, far, parts), new_path(spark, "seen"), new_path(spark, "c")
        read = lambda: streams.read_table(spark, folder, SCHEMA, 1)
        streams.first_seen(read(), ["k"], ["ts", "id"], path, state).awaitTermination()
        got = spark.read.parquet(path).collect()
        assert sorted(str(r["k"]) for r in got) == ["None", "a", "b"]
        # More rows arrive later, after a stop: known keys stay out.
        spark.createDataFrame([(50, START, "a", 1), (51, START, "c", 1)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        streams.first_seen(read(), ["k"], ["ts", "id"], path, state).awaitTermination()
        assert sorted(str(r["k"]) for r in spark.read.parquet(path).collect()) == ["None", "a", "b", "c"]


def test_repeated_batch_is_written_once(spark, made):
    path = new_path(spark, "again")
    write = streams._batch_writer(path)
    batch = spark.createDataFrame(made, SCHEMA)
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(path).count() == len(made)
