"""Matching an ordered list of dates to a panel, group by group.

The list runs through one ticker's dates after another's, so a date earlier
than the one before it starts the next group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.columns import flag
from tidemark.operators import ranking
from tidemark.operators.reshape import union_all
from tidemark.operators.spread import spread_join
from tidemark.session import cut_lineage

CHUNK = 100_000
BLOCK = 10_000  # tickers that one task walks through


def listing(rows: DataFrame, by: str, date: str) -> DataFrame:
    """(pos, date): one key's dates after another's, numbered from 1.

    Each key starts where the keys before it end; a key's own dates are one
    per day, so only that much is sorted together.
    """
    rows = cut_lineage(rows)
    sizes = ranking.group_sizes(rows, [by], "_n")
    starts = ranking.totals_below(sizes, [], by, ["_n"]).select(by, "_n_below")
    within = F.row_number().over(W.partitionBy(by).orderBy(date))
    placed = rows.withColumn("_in", within).join(starts, by)
    return placed.select((F.col("_n_below") + F.col("_in")).alias("pos"), date)


def date_groups(dates: DataFrame, pos: str = "pos", date: str = "date", chunk: int = CHUNK) -> DataFrame:
    """`group_no` (from 1) and `in_group` (from 1) for each listed date.

    `pos` is the 1-based dense place in the list, with no missing dates. The
    list is cut into chunks that see the last row of the chunk before; breaks
    are counted per chunk and carried over, so no task orders the whole list.
    """
    home = F.floor((F.col(pos) - 1) / chunk)
    last_of_chunk = F.col(pos) % chunk == 0
    rows = cut_lineage(dates).withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(last_of_chunk, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    ordered = W.partitionBy("_chunk").orderBy(pos)
    falls = F.col(date) < F.lag(date, 1).over(ordered)
    rows = rows.withColumn("_break", flag(falls)).where(F.col("_chunk") == F.col("_home"))
    sums = rows.groupBy("_chunk").agg(F.sum("_break").alias("_b"))
    earlier = W.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_chunk", F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum("_break").over(ordered.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_in", inside).join(sums, "_chunk")
    rows = rows.withColumn("group_no", 1 + F.col("_before") + F.col("_in")).drop("_home", "_chunk", "_break", "_in", "_before")
    rows = cut_lineage(rows)
    starts = rows.groupBy("group_no").agg(F.min(pos).alias("_start"), F.count(F.lit(1)).alias("_n"))
    rows = spread_join(rows, starts, ["group_no"], "_n", [pos])
    return rows.withColumn("in_group", F.col(pos) - F.col("_start") + 1).drop("_start", "_n")


def _numbered(panel: DataFrame, order: str) -> DataFrame:
    """Tickers numbered in order, and each ticker's events within it."""
    tickers = ranking.key_positions(panel, "symbol", "group_no")
    events = F.row_number().over(W.partitionBy("symbol").orderBy(order)).cast("bigint")
    return panel.join(tickers, "symbol").withColumn("in_group", events)


def assign_dates(panel: DataFrame, groups: DataFrame, order: str = "event_only_index") -> DataFrame:
    """The j-th date of the i-th group on the j-th event of the i-th ticker.

    Events without a date of their own are left out.
    """
    side = groups.select("group_no", "in_group", F.col("date").alias("_ref"))
    rows = _numbered(panel, order).join(side, ["group_no", "in_group"])
    return rows.withColumn("date", F.col("_ref")).drop("_ref", "group_no", "in_group")


def unassigned(panel: DataFrame, groups: DataFrame, order: str = "event_only_index") -> DataFrame:
    """Listed dates that found no event."""
    taken = _numbered(panel, order).select("group_no", "in_group")
    return groups.join(taken, ["group_no", "in_group"], "left_anti")


def _serve(tickers: DataFrame, groups: DataFrame, now: int) -> DataFrame:
    """(group_no, ticker_no) of one block of tickers, group `now` being the first whose turn it is.

    Both sides hold a number and its `days`. One task walks through the block.
    """

    def walk(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        wanted = {g: set(days) for g, days in zip(theirs["group_no"], theirs["days"])}
        turn, out = now, []
        for ticker, days in sorted(zip(mine["ticker_no"], mine["days"]), key=lambda row: row[0]):
            if not wanted.get(turn, frozenset()).isdisjoint(days):
                out.append((turn, ticker))
                turn += 1
        return pd.DataFrame(out, columns=["group_no", "ticker_no"]).astype("int64")

    together = lambda df: df.withColumn("_block", F.lit(now)).groupBy("_block")
    return together(tickers).cogroup(together(groups)).applyInPandas(walk, "group_no bigint, ticker_no bigint")


def _served(numbered: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    days = lambda df, key: df.where("date is not null").select(key, F.unix_date("date").alias("_day")).groupBy(key).agg(
        F.collect_set("_day").alias("days")
    )
    # Ranges lie together, so a block reads its own rows only.
    tickers = cut_lineage(days(numbered, "ticker_no").repartitionByRange("ticker_no"))
    listed = cut_lineage(days(groups, "group_no").repartitionByRange("group_no"))
    last_ticker, last_group = (df.agg(F.max(key)).first()[0] or 0 for df, key in ((tickers, "ticker_no"), (listed, "group_no")))
    now, parts = 1, []
    for start in range(1, last_ticker + 1, block):
        if now > last_group:
            break
        # A ticker ends one wait at most, so a block serves no more groups than it has tickers.
        mine = tickers.where(F.col("ticker_no").between(start, start + block - 1))
        theirs = listed.where(F.col("group_no").between(now, now + block - 1))
        parts.append(cut_lineage(_serve(mine, theirs, now)))
        now += parts[-1].count()
    return union_all(*parts) if parts else numbered.sparkSession.createDataFrame([], "group_no bigint, ticker_no bigint")


def _with_tickers(panel: DataFrame) -> DataFrame:
    """The panel with `ticker_no`, stored: the chain and its use both read it."""
    panel = cut_lineage(panel)
    return cut_lineage(panel.join(ranking.key_positions(panel, "symbol", "ticker_no"), "symbol"))


def served(panel: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(group_no, ticker_no): the groups that find a ticker, in turn.

    Tickers come in order. The group whose turn it is waits for the first ticker that
    has one of its dates; the next group then starts with the ticker after. Which
    ticker ends a wait depends on all waits before it, so blocks of tickers follow one
    another, and all that a block hands to the next is the group whose turn it is. A
    ticker looks at one group only: the work grows with the rows, not with the pairs of a
    group and a ticker that share a date. A task holds one block of tickers and as many
    groups, whose dates are bounded by the calendar.
    """
    return _served(_with_tickers(panel), groups, block)


def flag_dates(panel: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """Panel rows whose date is in the group that their ticker has served; see `served`."""
    rows, groups = _with_tickers(panel), cut_lineage(groups.select("group_no", "date").distinct())
    pairs = _served(rows, groups, block)
    wanted = pairs.join(groups, "group_no").select("ticker_no", "date", F.lit(True).alias("orig_date"))
    rows = rows.join(wanted, ["ticker_no", "date"], "left").select(*panel.columns, "orig_date")
    return rows.withColumn("orig_date", F.coalesce("orig_date", F.lit(False)))


def waiting(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """Listed dates of the groups that no ticker has served."""
    return groups.join(served(panel, groups).select("group_no"), "group_no", "left_anti")
