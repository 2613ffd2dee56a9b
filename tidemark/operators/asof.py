"""Nearest as-of join by one sort per key, and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def nearest_asof(
    left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, value: str, tolerance_days: int = 7
) -> DataFrame:
    """The nearest `value` within the tolerance, the earlier one on a tie.

    Both sides are stacked and ordered once in each direction, so the work
    grows with the rows and never with their product. A key's rows are one per
    day at most, which bounds what a single task sorts.
    """
    rows = left.withColumns({"_at": F.col(left_on), "_side": F.lit(1)})
    marks = right.select(by, F.col(right_on).alias("_at"), F.struct(F.col(right_on).alias("at"), F.col(value).alias("v")).alias("_mark"))
    both = rows.unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    back = W.partitionBy(by).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(by).orderBy(F.desc("_at"), "_side").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({
        "_prev": F.last("_mark", ignorenulls=True).over(back),
        "_next": F.last("_mark", ignorenulls=True).over(ahead),
    }).where(F.col("_side") == 1)
    gap_back = F.datediff("_at", F.col("_prev.at"))
    gap_ahead = F.datediff(F.col("_next.at"), "_at")
    take_back = gap_back.isNotNull() & (gap_ahead.isNull() | (gap_back <= gap_ahead))
    found = F.when(take_back & (gap_back <= tolerance_days), F.col("_prev.v")).when(
        ~take_back & (gap_ahead <= tolerance_days), F.col("_next.v")
    )
    return both.withColumn(value, found).drop("_at", "_side", "_mark", "_prev", "_next")


def fill_gaps(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Carry the last known value forward, then the first known one back."""
    forward = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    filled = F.coalesce(
        F.last(value, ignorenulls=True).over(forward),
        F.last(value, ignorenulls=True).over(back),
    )
    return df.withColumn(value, filled)


def market_cap(bars: DataFrame, shares: DataFrame, tolerance_days: int = 7) -> DataFrame:
    """Market value with the share count reported nearest to each day."""
    near = nearest_asof(bars, shares, "symbol", "date", "as_of", "diluted_shares", tolerance_days)
    filled = fill_gaps(near, "symbol", "date", "diluted_shares")
    return filled.withColumn("market_cap", F.col("diluted_shares") * F.col("close"))
