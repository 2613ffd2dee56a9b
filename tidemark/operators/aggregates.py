"""Daily sums, panel sums, frequency tables and metrics.

All are plain grouped sums: Spark adds up inside each input partition first, so
a hot company, source or date sends one row per partition, not all its news.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import flag, ratio, sum0, zero
from tidemark.operators import ranking
from tidemark.operators.joins import curated_only
from tidemark.operators.labels import PRODUCTS, interactions, one_hot, shares_of_mentions

DAILY_SUMS = ("positive", "negative") + PRODUCTS


def daily_news_sums(news: DataFrame, classes: DataFrame | None = None, organisation: bool = True) -> DataFrame:
    """Label counts by company and day, over organisation news of curated sources."""
    rows = news
    if organisation:
        rows = rows.where(F.col("b_org") == 1)
    if classes is not None:
        rows = curated_only(rows, classes)
    rows = interactions(one_hot(rows)).withColumn("date", F.to_date("published"))
    return rows.groupBy("company", "date").agg(*[sum0(c).alias(c) for c in DAILY_SUMS])


LABEL_SUMS = ("positive", "negative", "neutral", "label_0", "label_1", "positive_label_1", "negative_label_1")


def daily_label_sums(news: DataFrame) -> DataFrame:
    """Label counts by company and day over all news that has both."""
    rows = interactions(one_hot(news)).withColumn("date", F.to_date("published"))
    rows = rows.where(F.col("date").isNotNull() & F.col("company").isNotNull())
    return totals(rows, ["company", "date"], list(LABEL_SUMS))


def daily_news_ratios(news: DataFrame) -> DataFrame:
    """Counts by company and day with label-0 remainders and mention shares."""
    return shares_of_mentions(daily_label_sums(news))


def daily_uncertainty(df: DataFrame, pos: str = "positive", neg: str = "negative", date: str = "date") -> DataFrame:
    """max(0, 1 - neg / (pos + neg)) by day, 0 on days without sentiment."""
    day = df.groupBy(date).agg(sum0(pos).alias("_p"), sum0(neg).alias("_n"))
    share = ratio("_n", F.col("_p") + F.col("_n"))
    return day.select(date, F.greatest(F.lit(0.0), zero(1 - share)).alias("uncert"))


def illiquid_flags(df: DataFrame, q: float = 0.75) -> DataFrame:
    """1 for symbols whose mean illiquidity reaches the quantile over symbols."""
    means = df.groupBy("symbol").agg(F.avg("illiquidity").alias("illiquidity"))
    border = ranking.quantiles(means, [], "illiquidity", {"_border": q})
    return means.select("symbol", "illiquidity", flag(F.col("illiquidity") >= border.scalar()).alias("illiq"))


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def totals(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[sum0(c).alias(c) for c in columns])


def rolled_totals(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Totals at every level of `by`, from one pass."""
    return df.rollup(*by).agg(*[sum0(c).alias(c) for c in columns])


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column (and group)."""
    keys = (by or []) + ["column"]
    values = [F.col(c).cast("double").alias(c) for c in columns]
    long = df.select(*(by or []), *values).unpivot(by or [], columns, "column", "value").where("value is not null")
    basic = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = ranking.quantiles(long, keys, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quartiles, keys)


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row label against column label; one column per known value."""
    return df.groupBy(row).agg(*[F.sum(flag(F.col(column) == v)).alias(f"{column}_{v}") for v in values])


def matrix(df: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Long (row, column, value) as one column per name."""
    return df.groupBy(row).agg(*[F.max(F.when(F.col(column) == n, F.col(value))).alias(n) for n in names])


def confusion(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """How many rows there are, what class 1 found, wrongly found and missed, and how often both agree."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(flag(y & p)).alias("_tp"),
        F.sum(flag(~y & p)).alias("_fp"),
        F.sum(flag(y & ~p)).alias("_fn"),
        F.sum(flag(F.col(label) == F.col(prediction))).alias("_same"),
    )


def rates(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall and F1 from the counts of `confusion`; 0 where undefined."""
    return counts.select(
        *(by or []),
        zero(ratio("_same", "_n")).alias("accuracy"),
        zero(ratio("_tp", F.col("_tp") + F.col("_fp"))).alias("precision"),
        zero(ratio("_tp", F.col("_tp") + F.col("_fn"))).alias("recall"),
        zero(ratio(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))).alias("f1"),
    )


def binary_metrics(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall and F1 of class 1; 0 where undefined."""
    return rates(confusion(df, label, prediction, by), by)


def weighted_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """F1 of every class weighted by how often the class is true."""
    pairs = df.groupBy(F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    each = F.explode(F.array(
        F.struct(F.col("_y").alias("cls"), F.col("_c").alias("true"), F.lit(0).cast("bigint").alias("said"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_c")).otherwise(0).alias("hit")),
        F.struct(F.col("_p").alias("cls"), F.lit(0).cast("bigint").alias("true"), F.col("_c").alias("said"),
                 F.lit(0).cast("bigint").alias("hit")),
    )).alias("e")
    per = pairs.select(each).select("e.*").groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("true", "said", "hit")])
    f1 = zero(ratio(2 * F.col("hit"), F.col("true") + F.col("said")))
    return per.agg(ratio(F.sum(f1 * F.col("true")), F.sum("true")).alias("weighted_f1"))


def auc_gini(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at half, and Gini = 2 AUC - 1.

    Rows with one score are one point before any ordering is done.
    """
    y = F.col(label) == 1
    points = df.groupBy(score).agg(F.sum(flag(y)).alias("pos"), F.sum(flag(~y)).alias("neg"))
    ranks = ranking.totals_below(points, [], score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    auc = ranks.agg(ratio(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))
    return auc.withColumn("gini", 2 * F.col("auc") - 1)


def title_texts(news: DataFrame, order: tuple[str, ...] = ("published", "news_id")) -> DataFrame:
    """Titles of a company and day joined to one text, in order of arrival (rows without a time or id first)."""
    rows = news.select("company", F.to_date("published").alias("date"), *order, "title").where("title is not null")
    titles = F.sort_array(F.collect_list(F.struct(*order, "title")))
    grouped = rows.groupBy("company", "date").agg(titles.alias("_t"))
    return grouped.select("company", "date", F.concat_ws("", F.col("_t.title")).alias("text"))
