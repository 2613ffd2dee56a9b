"""Row expressions, joins and files on hand-made rows."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions import dates, finance as fin, text as tx
from tidemark.operators import aggregates as agg, asof, clean, ingest, joins, labels, prices, scoring
from tidemark.session import cut_lineage, new_path
from tidemark.sources import files


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{n} {'string' if isinstance(v, (str, type(None))) else 'double'}" for n, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_headline_parts(spark):
    assert one(spark, tx.last_part("t"), t="a - b - c") == "c"
    assert one(spark, tx.before_last_part("t"), t="a - b - c") == "a - b"
    assert one(spark, tx.last_part("t"), t="plain") is None
    assert one(spark, tx.before_last_part("t"), t="plain") == "plain"
    assert one(spark, tx.second_part("t"), t="a - b - c") == "b"
    assert one(spark, tx.second_part("t"), t="plain") is None
    assert one(spark, tx.headline_group("t", 3), t="Rates rise - WIRE SERVICE") == "WIRE SERVICE"
    assert one(spark, tx.headline_group("t", 4), t="Flood - Kent, DE") == "Kent"
    assert one(spark, tx.headline_group("t", 5), t="Flood - Kent, DE") == "DE"


def test_combined_text(spark):
    c = lambda **kw: one(spark, tx.combined("t", "s", "b"), **kw)
    assert c(t=" Title ", s="news", b=" body\n") == "Title. body"
    assert c(t="  ", s="news", b="body") == "news. body"
    assert c(t="", s=None, b="body") == "body"


def test_source_is_kept_when_present(spark):
    df = spark.createDataFrame([("a - b", "z")], "title string, source string")
    assert rows(clean.split_title_source(df)) == [("a - b", "z")]


def test_ascii_drops_missing(spark):
    df = spark.createDataFrame([("plain\ntext",), ("naïve",), (None,), ("",)], "t string")
    assert sorted(r[0] for r in clean.drop_non_ascii(df, "t").collect()) == ["", "plain\ntext"]


def test_dates(spark):
    assert one(spark, dates.parse_date("t"), t="nonsense") is None
    assert one(spark, dates.parse_date("t"), t="2020-01-01T00:30:00+02:00") == dt.date(2019, 12, 31)


@pytest.mark.parametrize("day,want", [
    ("2021-01-01", "2021-01-04"), ("2021-12-24", "2021-12-27"), ("2022-01-01", "2022-01-03"), ("2021-07-05", "2021-07-06"),
    ("2023-05-29", "2023-05-30"), ("2023-11-23", "2023-11-24"), ("2020-06-19", "2020-06-19"), ("2023-06-19", "2023-06-20"),
    ("2023-01-16", "2023-01-17"), ("1985-01-21", "1985-01-21"), ("2023-03-15", "2023-03-15"), ("2023-10-09", "2023-10-10"),
    ("2021-12-31", "2022-01-03"),
])
def test_business_days(spark, day, want):
    assert str(one(spark, dates.next_open_day(F.to_date("d")), d=day)) == want


def test_holidays_match_the_calendar_library(spark):
    from pandas.tseries.holiday import USFederalHolidayCalendar

    days = pd.date_range("1990-01-01", "2035-12-31")
    want = set(USFederalHolidayCalendar().holidays("1990-01-01", "2035-12-31").date)
    df = spark.sql("select explode(sequence(date'1990-01-01', date'2035-12-31')) d")
    got = {r["d"] for r in df.where(dates.is_holiday(F.col("d"))).collect() if r["d"].weekday() < 5}
    assert got == {d for d in want if d.weekday() < 5} and len(days) == df.count()


def test_significance_of_missing_is_neither(spark):
    df = spark.createDataFrame([(2.0,), (-2.0,), (0.1,), (None,)], "x double")
    assert [r[0] for r in df.select(fin.significance("x")).collect()] == [1, 2, 0, 0]


def test_asof_against_every_row(spark):
    bars = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(0, 60, 1)] + [("b", dt.date(2020, 1, 1))]
    marks = [("a", dt.date(2020, 1, 10), 1), ("a", dt.date(2020, 1, 14), 2), ("a", dt.date(2020, 2, 20), 3)]
    left = spark.createDataFrame(bars, "symbol string, date date")
    right = spark.createDataFrame(marks, "symbol string, as_of date, n int")
    got = {(r["symbol"], r["date"]): r["n"] for r in asof.nearest_asof(left, right, "symbol", "date", "as_of", "n", 7).collect()}
    for s, d in bars:
        near = [(abs((m - d).days), m, n) for k, m, n in marks if k == s and abs((m - d).days) <= 7]
        assert got[(s, d)] == (min(near)[2] if near else None)
    filled = asof.fill_gaps(asof.nearest_asof(left, right, "symbol", "date", "as_of", "n", 7), "symbol", "date", "n")
    assert {r["n"] for r in filled.where("symbol = 'a'").collect()} == {1, 2, 3}


def test_uncertainty_edges(spark):
    df = spark.createDataFrame([("d1", 0, 0), ("d2", 1, 3), ("d3", 2, 0), ("d4", None, None)], "date string, positive int, negative int")
    assert rows(agg.daily_uncertainty(df), "date") == [("d1", 0.0), ("d2", 0.25), ("d3", 1.0), ("d4", 0.0)]


def test_rare_values_fold(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)], "s string")
    assert sorted(str(r[0]) for r in labels.fold_rare(df, "s", threshold=1).collect()) == ["None", "Other", "a", "a", "a"]


def test_categories_without_limit(spark):
    df = spark.range(1500).selectExpr("string(id % 1300) s").union(spark.sql("select cast(null as string)"))
    assert labels.categories(df, "s") == sorted(str(i) for i in range(1300))
    out = labels.indexed(df, "s", "v").select("s", "v").collect()
    assert {r["v"].size for r in out} == {1300} and all(len(r["v"].indices) == (r["s"] is not None) for r in out)


def test_balance_of_nothing_is_missing(spark):
    df = spark.createDataFrame([(0, 0), (3, 1)], "p int, n int")
    assert [r[0] for r in labels.balance_indices(df, [("p", "n")]).select("p_index").collect()] == [None, 0.05]


def test_surprise_column_found_by_name(spark):
    bars = spark.createDataFrame([("a", 1)], "symbol string, date int")
    rel = spark.createDataFrame([("a", 1, 2.0)], "symbol string, date int, `Surprise(%)` double")
    assert rows(prices.join_earnings(bars, rel).select("surprise_percent")) == [(2.0,)]
    assert rows(prices.join_earnings(bars, rel.drop("Surprise(%)")).select("surprise_percent")) == [(None,)]


def test_windowed_search(spark):
    news = spark.createDataFrame([("Acme Corp rises", dt.date(2020, 1, 4)), ("other", dt.date(2020, 1, 4))], "title string, published date")
    terms = spark.createDataFrame([("acme corp", "name"), ("ACME", "ticker"), ("Corp x", "name")], "term string, kind string")
    out = ingest.windowed_search(news, terms, "2020-01-01", "2020-01-04")
    assert rows(out.select("kind", F.col("window_start").cast("string")), "kind", "window_start") == [
        (k, f"2020-01-0{d}") for k in ("name", "ticker") for d in (1, 2, 3)
    ]


def test_page_links(spark):
    html = '<ul><li><a href="/x">One</a></li><li>no link</li><li class="k"> <a class="c" href="http://y">Two</a></li></ul>'
    df = spark.createDataFrame([(1, "https://news.example.com/p?q", html)], "page_id int, url string, html string")
    assert rows(ingest.page_links(df), "place") == [
        (1, 0, "/x", "One", "news.example.com"), (1, 1, "http://y", "Two", "news.example.com")
    ]


def test_files_keep_awkward_text(spark):
    texts = ['quoted "x"; and\nnew line', "  blanks  ", "back\\slash", "", "ü"]
    df = spark.createDataFrame([(t, t, 1) for t in texts], "title string, text string, label int")
    path = files.write_delimited(df, new_path(spark, "t"), ";")
    back = files.read_escaped(spark, path, files.SPLIT_SCHEMA, ";")
    assert sorted((r["text"] or "") for r in back.collect()) == sorted(texts)
    back = files.read_delimited(spark, files.write_plain(df, new_path(spark, "t"), ";"), files.SPLIT_SCHEMA, ";")
    assert sorted((r["text"] or "") for r in back.collect()) == sorted(texts)


def test_stage_is_written_once(spark):
    path = new_path(spark, "stage")
    first = files.stage(spark.range(3).toDF("x"), path)
    again = files.stage(spark.range(9).toDF("x"), path)
    assert first.count() == again.count() == 3
    assert files.stage(spark.range(9).toDF("x"), path, rows=2).count() == 2
    with pytest.raises(ValueError):
        files.sink(spark.range(1).toDF("x"), path, "xlsx")


def test_ingest_resumes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    store = new_path(spark, "store")
    df.where("k = 'a'").write.parquet(store)
    assert ingest.ingest_missing(df, store, "k").count() == 3
    assert ingest.ingest_missing(df, store, "k").count() == 3


def test_known_entities_are_sent_to_the_rows(spark):
    """Their keys are few, whatever the size of the store they are read from: the rows themselves are not shuffled."""
    df = cut_lineage(spark.range(20).selectExpr("id % 10 k", "id v"))
    known = spark.range(50_000_000).selectExpr("id % 7 k").where("k < 3")
    left = ingest.unprocessed(df, known, "k")
    assert "BroadcastHashJoin" in left._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r["k"] for r in left.collect()) == sorted([*range(3, 10)] * 2)


def test_scores_and_tags(spark):
    df = spark.createDataFrame([(1, "Good good bad"), (2, None), (3, "bad")], "id int, text string")
    out = scoring.lexicon_score(df, "text", ["good"], ["bad"]).select("id", "label", "score")
    assert [(r[0], r[1], round(r[2], 3)) for r in out.orderBy("id").collect()] == [(1, "positive", 0.333), (2, "neutral", 0.0), (3, "negative", 1.0)]
    tags = df.select(scoring.entity_tags(F.lit("Acme met Bob and Acme"), {"ORG": ["Acme"], "PER": ["Bob"], "LOC": ["Rome"]}).alias("t")).first()["t"]
    assert tags == {"ORG": ["Acme", "Acme"], "PER": ["Bob"]}


def test_model_is_loaded_once_per_task(spark):
    def load():
        def score(texts):
            return texts.str.upper(), texts.str.len().astype(float)

        return score

    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    assert rows(scoring.model_score(df, "text", load).select("id", "label", "score"), "id") == [(1, "AB", 2.0), (2, "", 0.0)]


def test_curated_and_members(spark):
    news = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, source string")
    classes = spark.createDataFrame([("x", 1.0, None), ("y", None, 0.0)], "source string, relevant double, traditional double")
    assert rows(joins.curated_only(news, classes).select("id")) == [(1,)]
    assert rows(joins.members(news, classes, ["source"]).select("id"), "id") == [(1,), (2,)]
    assert rows(joins.non_members(news, classes, ["source"]).select("id")) == [(3,)]
