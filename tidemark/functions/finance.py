"""Return, illiquidity and significance expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.columns import col, ratio

# Standard normal quantiles at 0.95 and 0.6.
Z_95 = 1.6448536269514722
Z_60 = 0.2533471031357997


def day_return(open_: str | Column = "open", close: str | Column = "close") -> Column:
    return ratio(col(close) - col(open_), open_)


def illiquidity(returns="returns", high="high", volume="volume") -> Column:
    """|return| over high squared times half the volume."""
    h = col(high)
    return ratio(F.abs(col(returns)), h * h * col(volume) / F.lit(2))


def abnormal_return(returns, beta, market) -> Column:
    """What the market model leaves unexplained, in percent."""
    return F.lit(100) * (col(returns) - col(beta) * col(market))


def capm_abnormal_return(returns, beta, market, rf) -> Column:
    expected = col(rf) + col(beta) * (col(market) - col(rf))
    return F.lit(100) * (col(returns) - expected)


def significance(stat, crit: float = Z_95, codes=(1, 2, 0)) -> Column:
    """Class of a statistic: high, low, neither; a missing one is neither."""
    high, low, neither = (F.lit(c) for c in codes)
    return F.when(col(stat) >= crit, high).when(col(stat) <= -crit, low).otherwise(neither)
