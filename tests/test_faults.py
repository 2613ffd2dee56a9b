"""Inputs on which earlier forms of these operators gave wrong rows or failed."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import ingest, publication_lag
from tidemark.plans import catalogue


def test_search_hits_next_to_signs(spark):
    titles = ["Apple, Tesla rise", "Apple rises", "(Apple) falls", "Pineapple", None, "New York-Times says", "new york"]
    news = spark.createDataFrame([(t, dt.date(2020, 1, 10)) for t in titles], "title string, published date")
    terms = spark.createDataFrame([("apple",), ("New York",), ("york times",), ("...",), (None,)], "term string")
    hits = ingest.windowed_search(news, terms, "2020-01-10", "2020-01-11", 1)
    assert sorted((r["term"], r["title"]) for r in hits.collect()) == [
        ("New York", "New York-Times says"), ("New York", "new york"), ("apple", "(Apple) falls"),
        ("apple", "Apple rises"), ("apple", "Apple, Tesla rise"), ("york times", "New York-Times says"),
    ]


def test_search_without_terms(spark):
    news = spark.createDataFrame([("a", dt.date(2020, 1, 10))], "title string, published date")
    terms = spark.createDataFrame([], "term string")
    assert ingest.windowed_search(news, terms, "2020-01-10", "2020-01-11", 1).collect() == []


def lag_rows(spark, hour, nets=(3, -1, 2, 5, -4)):
    """Sentiment that follows the returns of the day it was published on, at one hour of the day."""
    days = [dt.datetime(2021, 3, 2) + dt.timedelta(days=k) for k in (0, 1, 2, 6, 7)]
    news = [("s", 1, d + dt.timedelta(hours=hour), max(n, 0), max(-n, 0)) for d, n in zip(days, nets)]
    bars = [(1, (d + dt.timedelta(days=k)).date(), float(n) if k == 0 else 0.1 * (i % 2)) for i, (d, n) in enumerate(zip(days, nets)) for k in (0,)]
    return (
        spark.createDataFrame(news, "source string, company long, published timestamp_ntz, positive int, negative int"),
        spark.createDataFrame(bars, "symbol long, date date, returns double"),
    )


@pytest.mark.parametrize("hour,same_day", [(0, [0.0]), (7, [0.0, 0.25]), (13, [0.0, 0.25, 0.5]), (23, [0.0, 0.25, 0.5, 0.75])])
def test_lags_keep_the_time_of_day(spark, hour, same_day):
    news, bars = lag_rows(spark, hour)
    scores = {r["lag_days"]: r["score"] for r in publication_lag.lag_scores(news, bars).collect()}
    assert [lag for lag, s in sorted(scores.items()) if s == 1.0] == same_day


def test_flat_source_has_no_score(spark):
    news, bars = lag_rows(spark, 7, nets=(2, 2, 2, 2, 2))
    both = news.union(lag_rows(spark, 7)[0].withColumn("source", F.lit("moving")))
    _, bars = lag_rows(spark, 7)
    best = {r["source"]: r["score"] for r in publication_lag.best_lags(both, bars).collect()}
    assert best == {"s": None, "moving": 1.0}


def test_the_calendar_rolls_once_per_day(spark, monkeypatch):
    news, bars = lag_rows(spark, 7)
    rolled = spark.sparkContext.accumulator(0)

    @F.udf("date")
    def open_day(day):
        rolled.add(1)
        return day

    monkeypatch.setattr(publication_lag, "next_open_day", lambda c: open_day(c))
    many = news.crossJoin(spark.range(40).withColumnRenamed("id", "n")).drop("n")
    scores = {r["lag_days"]: r["score"] for r in publication_lag.lag_scores(many, bars).collect()}
    assert scores[0.0] == 1.0 and scores[0.25] == 1.0
    assert rolled.value <= 5  # days, not 200 rows


def test_lags_without_prices_are_left_out(spark):
    news, bars = lag_rows(spark, 0)
    one = bars.where("date = date '2021-03-08'")
    found = publication_lag.lag_scores(news.where("published = timestamp_ntz '2021-03-08 00:00:00'"), one).collect()
    assert [(r["lag_days"], r["score"]) for r in found] == [(0.0, None)]


@pytest.mark.parametrize("name", ["stream_ingest", "stream_first_story", "stream_daily_sums"])
def test_streams_read_folders_of_parts(spark, tmp_path, name):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    one = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    many = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert one and sorted(map(str, one)) == sorted(map(str, many))


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def fake_session(master, preset=None):
    made = {}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: made.get("dir"), setCheckpointDir=lambda d: made.update(dir=f"file:{d}/1")
    )
    return SimpleNamespace(conf=Conf({"spark.checkpoint.dir": preset} if preset else {}), sparkContext=context)


def test_shared_folder():
    assert session.shared_dir(fake_session("spark://x", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("local", "local[4]", "local[*]"):
        own = fake_session(master)
        first = session.shared_dir(own)
        assert first == session.shared_dir(own) and "tidemark-" in first
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://x"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake_session(master))


def test_delimited_records_are_lines(spark, tmp_path):
    from tidemark.sources import files

    texts = ["two\nlines", "a \\n that is none", "cr\r\nlf", 'say "x"; y, z', " blanks ", "\\", "", None, "tab\tend\\\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    path = files.write_delimited(df, f"{tmp_path}/x")
    back = {r["i"]: r["t"] for r in files.read_escaped(spark, path, "i int, t string").collect()}
    assert [back[i] or "" for i in range(len(texts))] == [t or "" for t in texts]
    assert spark.read.text(path).count() == len(texts) + 1
    plain = spark.createDataFrame([(1, "two\nlines")], "i int, t string").coalesce(1)
    plain.write.options(header="true", **files.QUOTED).csv(f"{tmp_path}/y")
    assert files.read_delimited(spark, f"{tmp_path}/y", "i int, t string").first()["t"] == "two\nlines"
