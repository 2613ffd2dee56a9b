"""How late each source publishes, judged by the returns its news goes with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import next_open_day
from tidemark.session import broadcast_days, cut_lineage

LAG_DAYS = (0.0, 0.25, 0.5, 0.75)


def lag_scores(news: DataFrame, bars: DataFrame, lags: tuple[float, ...] = LAG_DAYS) -> DataFrame:
    """|correlation| of net sentiment with the day's return per source and lag.

    The day rolls to the next open one and keeps its time of day until the lag
    is taken off. A source whose sentiment or returns never change has no
    score. The calendar rolls once per day, not per row. A row goes out once per
    day that its lags lead to, not once per lag, and is summed by (source,
    company, day) where it was read, so only daily sums meet the prices.
    """
    day = F.to_date("published")
    time_of_day = F.unix_timestamp(F.col("published").cast("timestamp")) - F.unix_timestamp(day.cast("timestamp"))
    net = F.col("positive") - F.col("negative")
    # Stored, as the days are listed before the rows are moved.
    rows = cut_lineage(news.select("source", "company", day.alias("_day"), time_of_day.alias("_time"), net.alias("_net")))
    days = rows.select("_day").distinct().withColumn("_open", next_open_day("_day"))
    back = [F.floor((F.col("_time") - int(l * 86400)) / 86400).cast("int") for l in lags]
    rows = rows.join(broadcast_days(days), "_day").withColumn("_back", F.explode(F.array_distinct(F.array(*back))))
    here = [b == F.col("_back") for b in back]
    used = sum((F.when(h, F.lit(1 << i)).otherwise(0) for i, h in enumerate(here)), F.lit(0))
    daily = rows.groupBy("source", F.col("company").alias("symbol"), F.date_add("_open", F.col("_back")).alias("date")).agg(
        F.bit_or(used).alias("used"), *[F.sum(F.when(h, F.col("_net"))).cast("double").alias(f"net_{i}") for i, h in enumerate(here)]
    )
    joined = daily.join(bars.select("symbol", "date", "returns"), ["symbol", "date"])

    def score(net: str) -> Column:
        both = F.col(net).isNotNull() & F.col("returns").isNotNull()
        spread = F.stddev_pop(F.when(both, F.col(net))) * F.stddev_pop(F.when(both, F.col("returns")))
        return F.round(F.abs(F.try_divide(F.covar_pop(net, "returns"), spread)), 9)

    wide = joined.groupBy("source").agg(F.bit_or("used").alias("used"), *[score(f"net_{i}").alias(f"s_{i}") for i in range(len(lags))])
    each = F.explode(F.array(*[
        F.struct(F.lit(l).alias("lag_days"), F.col(f"s_{i}").alias("score"), F.lit(1 << i).alias("bit")) for i, l in enumerate(lags)
    ]))
    told = wide.select("source", "used", each.alias("e")).where(F.col("used").bitwiseAND(F.col("e.bit")) > 0)
    return told.select("source", "e.lag_days", "e.score")


def best_lags(news: DataFrame, bars: DataFrame, lags: tuple[float, ...] = LAG_DAYS) -> DataFrame:
    """The best lag of every source; the shortest one on a tie."""
    scores = lag_scores(news, bars, lags)
    best = F.max(F.struct(F.col("score"), (-F.col("lag_days")).alias("_neg"))).alias("b")
    return scores.groupBy("source").agg(best).select(
        "source", F.abs(F.col("b._neg")).alias("lag_days"), F.col("b.score").alias("score")
    )
