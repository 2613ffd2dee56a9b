"""The given tables and the study views built on them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import configure, cut_lineage
from tidemark.sources.files import file_bytes


SPREAD_FROM, SPREAD_BELOW = 1 << 20, 64 << 20


def _volatility(days: DataFrame) -> DataFrame:
    level = F.lit(10.0) + (10 * F.col("n")).cast("double") / (1 + F.dayofmonth("date")).cast("double")
    return days.select("date", level.alias("vix_close"))


class Tables:
    """Views over one folder of Parquet tables.

    Every view is a lazy plan; nothing is read until the query that uses it
    runs, and only the columns that query touches are scanned.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        self.stock: DataFrame | None = None  # stages that `plans.study` stores once
        self.daily: DataFrame | None = None
        self.stored: Tables | None = None

    def table(self, name: str) -> DataFrame:
        """One Parquet table, its rows spread over the cores if it is a single small file.

        A file below the split size is read by one task, and everything up to
        the first shuffle would run there. Large tables come in many splits
        and are left as they are.
        """
        path = f"{self.folder}/{name}.parquet"
        df = self.spark.read.parquet(path)
        if SPREAD_FROM <= file_bytes(self.spark, path) < SPREAD_BELOW:
            df = df.repartition(self.spark.sparkContext.defaultParallelism)
        return df

    @cached_property
    def _trades(self) -> DataFrame:
        """Line items with exact decimal money columns."""
        price = F.col("l_extendedprice").cast("decimal(12,2)")
        pct = lambda c, sign: (F.lit(100) + sign * F.round(100 * F.col(c))).cast("decimal(3,0)")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("symbol"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_extendedprice").alias("price"),
            price.alias("open_part"),
            (price * pct("l_discount", -1) * pct("l_tax", 1)).alias("close_part"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").cast("decimal(4,2)").alias("dividend_part"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Prices: one row per (symbol, date)."""
        return self._trades.groupBy("symbol", "date").agg(
            F.sum("open_part").cast("double").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            (F.sum("close_part").cast("double") / F.lit(10000.0)).alias("close"),
            F.sum("quantity").cast("bigint").alias("volume"),
            F.sum("dividend_part").cast("double").alias("dividends"),
        )

    def with_stored_bars(self) -> Tables:
        """The same tables; bars are stored once, and releases and the volatility series are read from there."""
        if self.stored is None:
            other = self.stored = Tables(self.spark, self.folder)
            other.bars = cut_lineage(self.bars)
            # A symbol has one bar a day, so its symbols need no second shuffle to be told apart.
            other.vix = _volatility(other.bars.groupBy("date").agg(F.count("symbol").alias("n")))
        return self.stored

    @cached_property
    def index_bars(self) -> DataFrame:
        """The market series: one row per date."""
        return self._trades.groupBy("date").agg(
            F.sum("quantity").cast("bigint").alias("volume"),
            F.sum("open_part").cast("double").alias("open"),
            (F.sum("close_part").cast("double") / F.lit(10000.0)).alias("close"),
        )

    @cached_property
    def vix(self) -> DataFrame:
        """The volatility series: one row per date."""
        return _volatility(self._trades.groupBy("date").agg(F.count_distinct("symbol").alias("n")))

    @cached_property
    def rates(self) -> DataFrame:
        """Risk-free rate by date, with days missing on purpose."""
        days = self._trades.select("date").distinct()
        return days.where(F.dayofmonth("date") != 15).select(
            "date", (F.month("date").cast("double") / F.lit(10000.0)).alias("rf")
        )

    @cached_property
    def shares(self) -> DataFrame:
        """Yearly share counts, dated at the end of the year."""
        return (
            self._trades.groupBy("symbol", F.year("date").alias("y"))
            .agg((1000 * F.sum("quantity").cast("bigint")).alias("diluted_shares"))
            .select("symbol", F.make_date("y", F.lit(12), F.lit(31)).alias("as_of"), "diluted_shares")
        )

    @cached_property
    def releases(self) -> DataFrame:
        """Earnings releases: the first bar of each quarter."""
        first = self.bars.groupBy("symbol", F.year("date").alias("y"), F.quarter("date").alias("q")).agg(
            F.min_by(F.struct("date", "open", "close", "volume"), "date").alias("b")
        )
        return first.select(
            "symbol",
            F.col("b.date").alias("date"),
            (F.col("b.open") / F.col("b.volume")).alias("eps_estimate"),
            (F.col("b.close") / F.col("b.volume")).alias("reported_eps"),
            (F.lit(100.0) * (F.col("b.close") - F.col("b.open")) / F.col("b.open")).alias("surprise_percent"),
        )

    @cached_property
    def news(self) -> DataFrame:
        """Scored news rows."""
        li, o, p = self.table("lineitem"), self.table("orders"), self.table("part")
        return (
            li.join(o, li.l_orderkey == o.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(
                F.concat_ws(
                    "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date")
                ).alias("news_id"),
                F.col("l_suppkey").alias("company"),
                F.col("o_orderdate").alias("published"),
                F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" - "), F.col("p_brand")).alias("title"),
                F.col("p_brand").alias("source"),
                F.when(F.col("l_returnflag") == "R", "negative")
                .when(F.col("l_returnflag") == "A", "positive")
                .otherwise("neutral")
                .alias("finbert"),
                F.when(F.col("l_linestatus") == "O", "LABEL_1").otherwise("LABEL_0").alias("fakebert"),
                F.when(F.col("o_orderpriority") < "4", 1).otherwise(0).alias("b_org"),
            )
        )

    @cached_property
    def sources_class(self) -> DataFrame:
        """Curated-source dimension."""
        number = F.substring("p_brand", 7, 10).cast("int")
        return self.table("part").select(
            F.col("p_brand").alias("source"),
            F.when(number % 3 == 0, 1).otherwise(0).alias("relevant"),
            F.when(number % 3 == 1, 1).otherwise(0).alias("traditional"),
        ).distinct()

    @cached_property
    def stories(self) -> DataFrame:
        """Whole texts as headlines with a source suffix; company = language."""
        return self.table("documents").select(
            "doc_id",
            F.col("lang").alias("company"),
            "source",
            F.concat(F.col("text"), F.lit(" - "), F.col("source")).alias("title"),
            F.col("text").alias("body"),
            F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("doc_id") * 7) % 1300).cast("int")).alias("published"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        """Labelled articles with a subject and a date."""
        d, l = self.table("documents"), self.table("labels")
        return d.join(l, "doc_id").select(
            "doc_id",
            F.substring_index("text", ".", 1).alias("title"),
            "text",
            F.col("source").alias("subject"),
            F.col("quality").alias("label"),
            F.date_add(F.lit("2014-01-01").cast("date"), ((F.col("doc_id") * 7) % 1600).cast("int")).alias("published"),
        )
