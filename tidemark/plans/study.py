"""The steps from price rows to event panels, bound to the tables once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import aggregates as agg, asof, event_panel as ep, event_study as es, joins, prices
from tidemark.session import cut_lineage, lying_together
from tidemark.sources.tables import Tables

START, END = "1996-01-01", "2000-12-31"


def market(t: Tables) -> DataFrame:
    return prices.market_series(t.index_bars, t.vix)


def stock(t: Tables) -> DataFrame:
    """Bars with returns, market value, earnings and the market's day, stored as a stage.

    The event windows, their symbol numbers and the panels all start from it, both panels
    of a query that makes two.
    """
    if t.stock is None:
        own = t.with_stored_bars()
        rows = prices.with_returns(asof.market_cap(own.bars, own.shares))
        with lying_together(t.spark):
            t.stock = cut_lineage(prices.join_market(prices.join_earnings(rows, own.releases), market(own)))
    return t.stock


def study(t: Tables, style: str = "symmetric", keep: str = "first", min_est_rows: int = 0) -> DataFrame:
    return es.event_study(stock(t), style=style, keep=keep, min_est_rows=min_est_rows)


def daily_news(t: Tables) -> DataFrame:
    return agg.daily_news_sums(t.news, t.sources_class)


def stored_news(t: Tables) -> DataFrame:
    """The daily sums as a stage: the shuffles of all news are gone before those of the price rows begin."""
    if t.daily is None:
        t.daily = cut_lineage(daily_news(t))
    return t.daily


def featured(t: Tables, style: str = "symmetric", fill_missing: bool = False) -> DataFrame:
    return ep.stock_with_features(study(t, style), stored_news(t), START, END, fill_missing)


def panel(t: Tables, style: str = "symmetric", date_of: str = "first", fill_missing: bool = False) -> DataFrame:
    return ep.event_panel(featured(t, style, fill_missing), date_of)


def listed(rows: DataFrame, first_stage: DataFrame) -> DataFrame:
    """Panel rows of the events that the first stage's panel holds."""
    keys = ["symbol", "event_only_index"]
    return joins.members(rows, first_stage.select(*keys).distinct(), keys)
