"""Event windows and panels against a row-by-row account of the rules."""

import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import rows
from tidemark.operators import event_study as es, rolling

SCHEMA = "symbol string, date date, returns double, market_return double, surprise_percent double"
DAY0 = dt.date(2020, 1, 1)


def beta_of(pairs):
    both = [(a, b) for a, b in pairs if a is not None and b is not None]
    market = [b for _, b in pairs if b is not None]
    if len(both) < 2 or len(market) < 2:
        return None
    ma, mb = (sum(c) / len(both) for c in zip(*both))
    cov = sum((a - ma) * (b - mb) for a, b in both) / (len(both) - 1)
    mean = sum(market) / len(market)
    var = sum((b - mean) ** 2 for b in market) / (len(market) - 1)
    return cov / var if var else None


def slow_study(series, rank, style, keep, min_est, est=50, span=10):
    """One symbol, one event after another, cell by cell."""
    n = len(series)
    cells = [dict(event_id=None, beta=None, ar=None, ar_signif=None, event=None) for _ in range(n)]
    k = 0
    for e in [i for i, r in enumerate(series) if r[2] is not None]:
        if style == "pre_event":
            ws, we = max(0, e - span), e
        else:
            ws, we = max(0, e - span // 2), min(n - 1, e + span // 2)
        start = max(0, ws - est)
        if ws - start < min_est:
            continue
        k += 1
        beta = beta_of([(r[0], r[1]) for r in series[start:ws]])
        for p in range(start, we + 1):
            r, m, _ = series[p]
            ar = 100 * (r - beta * m) if None not in (beta, r, m) else None
            sig = 0 if ar is None else 1 if ar >= 1.6448536269514722 else 2 if ar <= -1.6448536269514722 else 0
            new = dict(event_id=100 * rank + k, beta=beta, ar=ar, ar_signif=sig, event=1 if p >= ws else None)
            for name, value in new.items():
                if value is not None and (keep == "last" or cells[p][name] is None):
                    cells[p][name] = value
    return cells


def build(spark, data):
    flat = [
        (s, DAY0 + dt.timedelta(days=i), *row) for s, series in data.items() for i, row in enumerate(series)
    ]
    random.Random(1).shuffle(flat)
    return spark.createDataFrame(flat, SCHEMA)


def check(spark, data, style, keep, min_est=0):
    out = es.event_study(build(spark, data), style, keep, min_est)
    got = {(r["symbol"], r["date"]): r for r in out.collect()}
    for rank, s in enumerate(sorted(data), 1):
        for p, want in enumerate(slow_study(data[s], rank, style, keep, min_est)):
            r = got[(s, DAY0 + dt.timedelta(days=p))]
            for name in ("event_id", "ar_signif", "event"):
                assert r[name] == want[name], (s, p, name)
            for name in ("beta", "ar"):
                assert (r[name] is None) == (want[name] is None), (s, p, name)
                if want[name] is not None:
                    assert math.isclose(r[name], want[name], rel_tol=1e-6, abs_tol=1e-7), (s, p, name)


def series(rng, n, every):
    return [
        (rng.uniform(-0.1, 0.1), rng.uniform(-0.05, 0.05), rng.uniform(-5, 5) if rng.random() < every else None)
        for _ in range(n)
    ]


@pytest.mark.parametrize("style", ["symmetric", "pre_event"])
@pytest.mark.parametrize("keep", ["first", "last"])
@pytest.mark.parametrize("min_est", [0, 5])
def test_overlapping_events(spark, style, keep, min_est):
    rng = random.Random(7)
    data = {"a": series(rng, 200, 0.06), "b": series(rng, 70, 0.1), "c": series(rng, 8, 0.5), "d": series(rng, 130, 0)}
    data["e"] = [(r, None if i % 9 == 0 else m, s) for i, (r, m, s) in enumerate(series(rng, 150, 0.05))]
    data["f"] = [(r, 0.01, s) for r, _, s in series(rng, 90, 0.1)]  # constant market: no beta
    check(spark, data, style, keep, min_est)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.sampled_from(["symmetric", "pre_event"]), st.sampled_from(["first", "last"]))
def test_any_series(spark, seed, style, keep):
    rng = random.Random(seed)
    data = {s: series(rng, rng.randint(1, 140), rng.random() * 0.2) for s in "xyz"}
    check(spark, data, style, keep)


def test_style_is_checked(spark):
    with pytest.raises(ValueError):
        es.event_study(build(spark, {"a": [(0.1, 0.1, None)]}), style="other")


def test_rolling_sums_cross_chunks(spark):
    values = [1, 2, None, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)] + [("b", 1, 5)], "k string, pos int, x int")
    for chunk in (3, 4, 5, 100):
        out = rolling.rolling_sums(df, ["k"], "pos", {"x": "s"}, [2, 3], chunk=chunk).where("k = 'a'")
        got = [(r["s_2"], r["s_3"]) for r in out.orderBy("pos").collect()]
        for i, pair in enumerate(got):
            for n, value in zip((2, 3), pair):
                part = values[i - n + 1 : i + 1] if i >= n - 1 else [None]
                assert value == (sum(part) if None not in part else None)
    assert rows(rolling.rolling_sums(df, ["k"], "pos", {"x": "s"}, [2]).where("k = 'b'").select("s_2")) == [(None,)]
