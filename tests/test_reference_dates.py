"""Groups of dates that wait for a ticker, against the rule taken literally."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import reference_dates as ref

DAY = dt.date(2024, 1, 1)


def literal(tickers, groups):
    """(group, ticker) pairs, one ticker after another."""
    now, out = 1, []
    for t in sorted(tickers):
        if now in groups and tickers[t] & groups[now]:
            out.append((now, t))
            now += 1
    return out


def test_groups_wait_and_tickers_are_skipped(spark):
    rng = random.Random(6)
    seen = set()
    for n in range(5):
        days = [DAY + dt.timedelta(days=i) for i in range(rng.choice([3, 6, 30]))]
        tickers = {f"t{i:02d}": set(rng.sample(days, rng.randrange(1, 4))) for i in range(rng.randrange(1, 30))}
        groups = {g: set(rng.sample(days, rng.randrange(1, 3))) for g in range(1, rng.randrange(2, 14))}
        panel = spark.createDataFrame([(t, d, k) for t in tickers for k, d in enumerate(sorted(tickers[t]))], "symbol string, date date, event_only_index long")
        listed = spark.createDataFrame([(g, d, k) for g in groups for k, d in enumerate(sorted(groups[g]), 1)], "group_no long, date date, in_group long")
        want = literal(tickers, groups)
        seen.add(len(want) == len(groups))
        number = {t: i for i, t in enumerate(sorted(tickers), 1)}
        assert sorted(map(tuple, ref.served(panel, listed).collect())) == [(g, number[t]) for g, t in want]
        flagged = {(r.symbol, r.date) for r in ref.flag_dates(panel, listed).where("orig_date").collect()}
        assert flagged == {(t, d) for g, t in want for d in tickers[t] & groups[g]}
        assert {r.group_no for r in ref.waiting(panel, listed).collect()} == set(groups) - {g for g, _ in want}
    assert seen == {True, False}


def test_first_group_matches_nobody(spark):
    panel = spark.createDataFrame([("a", DAY, 1)], "symbol string, date date, event_only_index long")
    listed = spark.createDataFrame([(1, DAY + dt.timedelta(days=1), 1), (2, DAY, 1)], "group_no long, date date, in_group long")
    assert ref.served(panel, listed).collect() == [] and ref.waiting(panel, listed).count() == 2
    assert ref.served(panel.limit(0), listed).collect() == []


def test_blocks_of_tickers_follow_one_another(spark):
    rng = random.Random(11)
    days = [DAY + dt.timedelta(days=i) for i in range(8)]
    tickers = {f"t{i:02d}": set(rng.sample(days, 2)) for i in range(25)}
    groups = {g: set(rng.sample(days, 2)) for g in range(1, 16)}
    panel = spark.createDataFrame([(t, d, k) for t in tickers for k, d in enumerate(sorted(tickers[t]))], "symbol string, date date, event_only_index long")
    listed = spark.createDataFrame([(g, d, k) for g in groups for k, d in enumerate(sorted(groups[g]), 1)], "group_no long, date date, in_group long")
    number = {t: i for i, t in enumerate(sorted(tickers), 1)}
    want = [(g, number[t]) for g, t in literal(tickers, groups)]
    assert len(want) > 8
    for block in (1, 4, 25):
        assert sorted(map(tuple, ref.served(panel, listed, block).collect())) == want


def test_a_date_that_all_share_makes_no_pairs(spark, monkeypatch):
    n, stored = 600, []

    def cut(df):
        out = kept(df)
        stored.append(out.count())
        return out

    kept = ref.cut_lineage
    monkeypatch.setattr(ref, "cut_lineage", cut)
    panel = spark.range(n).select(F.format_string("t%05d", "id").alias("symbol"), F.lit(DAY).alias("date"), F.lit(1).alias("event_only_index"))
    listed = spark.range(1, n + 1).select(F.col("id").alias("group_no"), F.lit(DAY).alias("date"), F.lit(1).alias("in_group"))
    assert ref.flag_dates(panel, listed).where("orig_date").count() == n
    assert max(stored) <= n
