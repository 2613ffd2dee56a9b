"""Price rows with news features, and the panels summed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.columns import sum0
from tidemark.operators import joins, labels, prices
from tidemark.operators.aggregates import daily_uncertainty, illiquid_flags
from tidemark.operators.event_study import event_only_index
from tidemark.operators.labels import PRODUCTS
from tidemark.operators.rolling import rolling_sums
from tidemark.session import cut_lineage, lying_together

LAGS = [20, 40, 60, 120]
ROLLED = dict(zip(PRODUCTS, ("pl1", "nl1", "pl0", "nl0", "rpl1", "rnl1", "rpl0", "rnl0")))
ROLLED_NAMES = [f"{p}_{n}" for n in LAGS for p in ROLLED.values()]
BALANCED = (("pl1", "nl1"), ("pl0", "nl0"), ("rpl1", "rnl1"), ("rpl0", "rnl0"))
INDEX_PAIRS = [(f"{p}_{n}", f"{q}_{n}") for n in LAGS for p, q in BALANCED]
INDEX_NAMES = [f"{p}_index" for p, _ in INDEX_PAIRS]

SUMMED = [
    "volume", "dividends", "stock_splits", "market_cap", "market_return", "market_return_yesterday", "vix_close",
    "vix_return", "vix_return_yesterday", "returns", "ar", "eps_estimate", "reported_eps", "surprise_percent",
]


def rolling_sentiment(df: DataFrame, fill_missing: bool = False, lags: list[int] | None = None) -> DataFrame:
    """Sums of the label products over a symbol's last rows.

    Days without news are missing and leave the windows they touch empty, or
    count as 0 with `fill_missing`.
    """
    if fill_missing:
        df = df.na.fill(0, list(PRODUCTS))
    pos = F.row_number().over(W.partitionBy("symbol").orderBy("date"))
    rows = df.withColumn("_row", pos)
    return rolling_sums(rows, ["symbol"], "_row", ROLLED, lags or LAGS, complete=fill_missing).drop("_row")


def stock_with_features(
    study: DataFrame, daily: DataFrame, start: str, end: str, fill_missing: bool = False
) -> DataFrame:
    """Price rows in the date range with news sums, uncertainty, illiquidity and rolling sums.

    The joined rows are stored once: the illiquidity border, the day
    uncertainty and the windows each read the few columns they need from there.
    """
    day = F.col("date")
    rows = joins.stock_with_news(study, daily).where(
        day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    with lying_together(study.sparkSession):
        rows = cut_lineage(prices.with_illiquidity(event_only_index(rows)))
    rows = rows.join(illiquid_flags(rows).select("symbol", "illiq"), "symbol", "left")
    return rolling_sentiment(rows, fill_missing)


def panel_features(panel: DataFrame) -> DataFrame:
    """Balance indices, and every index and product times each market state."""
    out = labels.balance_indices(panel, INDEX_PAIRS)
    made = {f"{c}_{s}": F.col(s) * F.col(c) for s in ("uncert", "illiq") for c in INDEX_NAMES + list(PRODUCTS)}
    return out.withColumns(made)


def event_panel(rows: DataFrame, date_of: str = "first") -> DataFrame:
    """One row per (symbol, event): sums, mean volatility, and the state of the first or last day.

    Rows outside event windows drop out before the shuffle.
    """
    inside = rows.where(F.col("event_only_index").isNotNull())
    kept = [c for c in SUMMED if c in rows.columns] + ["event", "event_id"] + list(PRODUCTS) + ["illiq"] + ROLLED_NAMES
    ends = {"first": F.min, "last": F.max}[date_of]
    panel = inside.groupBy("symbol", "event_only_index").agg(
        ends("date").alias("date"),
        F.avg("vix_close").alias("vix_index_avg"),
        *[sum0(c).alias(c) for c in kept],
    )
    panel = joins.day_lookup(panel, daily_uncertainty(rows))
    return panel_features(panel)


def day_panel(rows: DataFrame) -> DataFrame:
    """One row per (symbol, date), summed, without regard to events."""
    uncert = daily_uncertainty(rows)
    kept = [c for c in SUMMED if c in rows.columns] + list(PRODUCTS) + ["event_only_index", "illiq"] + ROLLED_NAMES
    rows = joins.day_lookup(rows, uncert).withColumn("vix_index_avg", F.col("vix_close"))
    panel = rows.groupBy("symbol", "date").agg(*[sum0(c).alias(c) for c in kept + ["uncert", "vix_index_avg"]])
    return panel_features(panel)
