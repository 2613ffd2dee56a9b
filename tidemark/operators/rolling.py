"""Rolling sums and rolling market models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import finance as fin
from tidemark.functions.columns import ratio
from tidemark.session import broadcast_days


def rolling_sums(
    df: DataFrame, by: list[str], pos: str, columns: dict[str, str], sizes: list[int], chunk: int = 100_000,
    complete: bool = False,
) -> DataFrame:
    """Sums of whole-number columns over the last n rows, for several n at once.

    Null until a window is full, and null when any of its values is missing.
    `columns` maps a column to its output prefix; `pos` is the 1-based dense
    position in the group. Each group is cut into chunks of rows that carry the
    tail of the chunk before them, so a group of any size spreads over tasks.
    A running total differenced at distance n replaces re-adding n values.
    `complete` says that no value is missing, which saves counting them.
    """
    reach = max(sizes)
    if reach > chunk:
        raise ValueError("a chunk must hold the longest window")
    home = F.floor((F.col(pos) - 1) / chunk)
    # The last `reach` rows of a chunk also go to the next one.
    tail = (F.col(pos) - 1) % chunk >= chunk - reach
    rows = df.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(tail, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    ordered = W.partitionBy(*by, "_chunk").orderBy(pos)
    running = ordered.rowsBetween(W.unboundedPreceding, 0)
    kinds = {"s": F.sum} if complete else {"s": F.sum, "k": F.count}
    rows = rows.withColumns({f"_{k}_{c}": f(c).over(running) for k, f in kinds.items() for c in columns})
    out = {}
    for n in sizes:
        for c, prefix in columns.items():
            since = lambda kind: F.coalesce(F.col(f"_{kind}_{c}"), F.lit(0)) - F.coalesce(
                F.lag(f"_{kind}_{c}", n).over(ordered), F.lit(0)
            )
            full = F.col(pos) >= n if complete else (F.col(pos) >= n) & (since("k") == n)
            out[f"{prefix}_{n}"] = F.when(full, since("s"))
    rows = rows.withColumns(out).where(F.col("_chunk") == F.col("_home"))
    return rows.drop("_home", "_chunk", *[f"_{k}_{c}" for k in kinds for c in columns])


def trailing_beta(df: DataFrame, far: int, near: int, returns: str = "returns", market: str = "market_return") -> DataFrame:
    """Adds `_beta`, `_rows` and `_pairs` over the rows `far` to `near` before each row of a symbol.

    Beta is sample covariance over sample variance of the market. Running
    totals are differenced, so the cost does not grow with the window. Values
    are taken from each symbol's first one, which keeps the totals small and a
    constant series exactly zero.
    """
    ordered = W.partitionBy("symbol").orderBy("date")
    running = ordered.rowsBetween(W.unboundedPreceding, 0)
    start = lambda c: F.first(c, ignorenulls=True).over(running)
    rows = df.withColumns({
        "_r": F.col(returns) - start(returns),
        "_m": F.col(market) - start(market),
        "_pos": F.row_number().over(ordered),
    })
    both = F.col("_r").isNotNull() & F.col("_m").isNotNull()
    parts = {
        "n": F.when(both, 1), "r": F.when(both, F.col("_r")), "m": F.when(both, F.col("_m")),
        "rm": F.col("_r") * F.col("_m"),
        "vn": F.when(F.col("_m").isNotNull(), 1), "vm": F.col("_m"), "vmm": F.col("_m") * F.col("_m"),
    }
    rows = rows.withColumns({f"_c_{k}": F.coalesce(F.sum(v).over(running), F.lit(0)) for k, v in parts.items()})
    at = lambda k, back: F.coalesce(F.lag(f"_c_{k}", back).over(ordered) if back else F.col(f"_c_{k}"), F.lit(0))
    rows = rows.withColumns({f"_d_{k}": at(k, near) - at(k, far + 1) for k in parts})
    n, vn = F.col("_d_n"), F.col("_d_vn")
    cov = ratio(F.col("_d_rm") - ratio(F.col("_d_r") * F.col("_d_m"), n), n - 1)
    var = ratio(F.col("_d_vmm") - ratio(F.col("_d_vm") * F.col("_d_vm"), vn), vn - 1)
    first, last = F.greatest(F.lit(1), F.col("_pos") - far), F.col("_pos") - near
    rows = rows.withColumns({
        "_beta": F.when((n > 1) & (vn > 1), ratio(cov, var)),
        "_rows": F.greatest(F.lit(0), last - first + 1),
        "_pairs": F.least(n, vn),
    })
    return rows.drop("_r", "_m", *[f"_{d}_{k}" for d in "cd" for k in parts])


def rolling_beta(df: DataFrame, window: int, returns: str = "returns", market: str = "market_return") -> DataFrame:
    """Beta over the last `window` rows of a symbol; null until the window is full."""
    rows = trailing_beta(df, window - 1, 0, returns, market)
    return rows.withColumn("beta", F.when(F.col("_pairs") == window, F.col("_beta"))).drop("_beta", "_rows", "_pairs", "_pos")


def market_model(df: DataFrame, window: int = 120, crit: float = fin.Z_60, codes=(0, 1, 2)) -> DataFrame:
    """Rolling beta, abnormal return and its class."""
    out = rolling_beta(df, window).withColumn("ar", fin.abnormal_return("returns", "beta", "market_return"))
    return out.withColumn("ar_signif", fin.significance("ar", crit, codes))


def capm(
    df: DataFrame, rates: DataFrame, window: int = 30, crit: float = fin.Z_95,
    codes=("Positive_relevance", "Negative_relevance", "Not_relevant"),
) -> DataFrame:
    """The same around a risk-free rate; days without a rate are left out after the beta."""
    out = rolling_beta(df, window).join(broadcast_days(rates), "date")
    out = out.withColumn("ar", fin.capm_abnormal_return("returns", "beta", "market_return", "rf"))
    return out.withColumn("ar_signif", fin.significance("ar", crit, codes))
