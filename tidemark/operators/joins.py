"""Joins of news, prices and small side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import zero
from tidemark.session import broadcast_days


def with_source_class(news: DataFrame, classes: DataFrame, key: str = "source") -> DataFrame:
    """Source class columns on every news row; unknown sources get nulls."""
    return news.join(classes, key, "left")


def curated_only(news: DataFrame, classes: DataFrame, key: str = "source") -> DataFrame:
    """News from sources classed as relevant or traditional.

    The class test runs on the small side, before the join, and the join is
    inner: rows of other sources are never carried.
    """
    keep = classes.where((zero("relevant") > 0) | (zero("traditional") > 0))
    return news.join(keep, key, "inner")


def stock_with_news(stock: DataFrame, daily: DataFrame, how: str = "left") -> DataFrame:
    """Daily news sums onto price rows by (symbol, date).

    News is already one row per company and day here, so no company is hot.
    """
    side = daily.withColumnRenamed("company", "symbol")
    return stock.join(side, ["symbol", "date"], how)


def day_lookup(df: DataFrame, by_day: DataFrame, on: str = "date") -> DataFrame:
    """A day's value for each row, null where the day has none."""
    return df.join(broadcast_days(by_day), on, "left")


def members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in `keys`."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def non_members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in `keys`."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")

