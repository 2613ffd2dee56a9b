"""Betas and abnormal returns around earnings releases.

Everything is a window over a symbol's days in order, and every window is a
running total or a look at one other row, so the work per row does not grow
with the windows. No event is ever expanded into its rows: a row asks which
event is nearest on either side. A symbol has one row per day, which bounds
the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import finance as fin
from tidemark.functions.columns import flag
from tidemark.operators import ranking
from tidemark.operators.rolling import trailing_beta

STYLES = {"symmetric": lambda span: (span // 2, span // 2), "pre_event": lambda span: (span, 0)}


def event_study(
    stock: DataFrame,
    style: str = "symmetric",
    keep: str = "first",
    min_est_rows: int = 0,
    est_rows: int = 50,
    span: int = 10,
    returns: str = "returns",
    market: str = "market_return",
    surprise: str = "surprise_percent",
    crit: float = fin.Z_95,
) -> DataFrame:
    """Adds event_id, beta, ar, ar_signif and event to price rows.

    An event is a row with a surprise. Its window is `span` rows around it
    (symmetric) or before it (pre_event); beta comes from the `est_rows` rows
    before the window. Where events overlap, every column takes the first (or
    last) event that has a value for it. Windows stop at the ends of a symbol's
    rows.
    """
    if style not in STYLES:
        raise ValueError(f"style must be one of {sorted(STYLES)}")
    for name in ("symbol", surprise):
        if name not in stock.columns:
            raise KeyError(name)
    before, after = STYLES[style](span)
    ordered = W.partitionBy("symbol").orderBy("date")
    running = ordered.rowsBetween(W.unboundedPreceding, 0)

    df = stock.join(ranking.key_positions(stock, "symbol", "_symbol_rank"), "symbol")
    df = trailing_beta(df, before + est_rows, before + 1, returns, market)
    df = df.withColumn("_kept", F.col(surprise).isNotNull() & (F.col("_rows") >= min_est_rows))
    ordinal = F.sum(flag(F.col("_kept"))).over(running)
    event_id = (F.lit(100) * F.col("_symbol_rank") + ordinal).cast("bigint")
    made = F.struct(F.col("_pos").alias("at"), event_id.alias("id"), F.col("_beta").alias("beta"))
    df = df.withColumn("_event", F.when(F.col("_kept"), made))
    df = df.withColumn("_fitted", F.when(F.col("_event.beta").isNotNull(), F.col("_event")))

    # An event writes the rows from its estimation start to its window end, so
    # a row is written by events from `after` rows back to `far` rows ahead.
    # The first of them is the first event from `after` rows back on; the last
    # is the last event up to `far` rows ahead.
    far = before + est_rows
    if keep == "first":
        order, reach = W.partitionBy("symbol").orderBy(F.desc("date")), after
    else:
        order, reach = ordered, far
    seen = order.rowsBetween(W.unboundedPreceding, 0)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumns({f"{c}_seen": F.last(c, ignorenulls=True).over(seen) for c in ("_event", "_fitted")})
    # Past the end of the symbol's rows the outermost event is the candidate.
    near = ordered.rowsBetween(-after, before)
    df = df.withColumns({
        f"{c}_by": F.coalesce(F.lead(f"{c}_seen", reach).over(order) if reach else F.col(f"{c}_seen"),
                              F.last(c, ignorenulls=True).over(whole))
        for c in ("_event", "_fitted")
    } | {"event": F.max(F.when(F.col("_kept"), F.lit(1))).over(near)})
    covers = lambda c: F.col(f"{c}.at").between(F.col("_pos") - after, F.col("_pos") + far)
    df = df.withColumns({
        "_owner": F.when(covers("_event_by"), F.col("_event_by")),
        "beta": F.when(covers("_fitted_by"), F.col("_fitted_by.beta")),
    })
    owner_ar = fin.abnormal_return(returns, "_owner.beta", market)
    df = df.withColumns({
        "event_id": F.col("_owner.id"),
        "ar": fin.abnormal_return(returns, "beta", market),
        "ar_signif": F.when(F.col("_owner").isNotNull(), fin.significance(owner_ar, crit)),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def event_only_index(df: DataFrame) -> DataFrame:
    """The event id on rows inside an event window, null elsewhere."""
    return df.withColumn("event_only_index", F.when(F.col("event") == 1, F.col("event_id")))


def market_adjusted(df: DataFrame) -> DataFrame:
    """The abnormal return, or return minus market where none was made; 0 if neither."""
    plain = F.lit(100) * (F.col("returns") - F.col("market_return"))
    return df.withColumn("ar", F.coalesce(F.col("ar"), plain, F.lit(0.0)))
