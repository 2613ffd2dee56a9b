"""Price, market and share-count operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import finance as fin
from tidemark.functions.columns import flag, ratio
from tidemark.session import broadcast_days


def with_returns(df: DataFrame) -> DataFrame:
    """Open-to-close return and its direction."""
    return df.withColumn("returns", fin.day_return()).withColumn("returns_binary", flag(F.col("returns") > 0))


def with_illiquidity(df: DataFrame) -> DataFrame:
    return df.withColumn("illiquidity", fin.illiquidity())


def shifted(df: DataFrame, column: str, out: str, by: list[str], order: str = "date", direction: str = "lead") -> DataFrame:
    """The next row's value per key (`lead`), or the previous one's (`lag`)."""
    move = {"lead": F.lead, "lag": F.lag}[direction]
    return df.withColumn(out, move(column, 1).over(W.partitionBy(*by).orderBy(order)))


def _calendar_window():
    # One row per day: the whole series is a calendar's length, whatever the data.
    return W.partitionBy(F.lit(0)).orderBy("date")


def percent_change(series: DataFrame, column: str, out: str) -> DataFrame:
    """Relative change to the day before, over a one-row-per-day series."""
    prev = F.lag(column, 1).over(_calendar_window())
    return series.withColumn(out, ratio(column, prev) - 1)


def market_series(index_bars: DataFrame, vix: DataFrame) -> DataFrame:
    """Index return and volatility by day, each with its shifted twin."""
    w = _calendar_window()
    idx = index_bars.select("date", fin.day_return().alias("market_return"))
    idx = idx.withColumn("market_return_yesterday", F.lead("market_return", 1).over(w))
    vol = percent_change(vix, "vix_close", "vix_return")
    joined = idx.join(broadcast_days(vol), "date", "left")
    return joined.withColumn("vix_return_yesterday", F.lead("vix_return", 1).over(w))


def join_market(df: DataFrame, market: DataFrame) -> DataFrame:
    """The day's market row onto every symbol's row of that day."""
    return df.join(broadcast_days(market), "date", "left")


def join_earnings(df: DataFrame, releases: DataFrame, surprise: str | None = None) -> DataFrame:
    """Earnings of the release day, found by (symbol, date).

    The surprise column is the one whose name says so, if not given.
    """
    found = surprise or next((c for c in releases.columns if "surprise" in c.lower()), None)
    if found is None:
        return df.withColumn("surprise_percent", F.lit(None).cast("double"))
    side = releases.withColumnRenamed(found, "surprise_percent")
    return df.join(side, ["symbol", "date"], "left")


def latest_market_cap(df: DataFrame, shares: DataFrame) -> DataFrame:
    """Market value with each symbol's newest share count on all its days."""
    latest = shares.groupBy("symbol").agg(F.max_by("diluted_shares", "as_of").alias("diluted_shares"))
    return df.join(latest, "symbol", "left").withColumn("market_cap", F.col("diluted_shares") * F.col("close"))
