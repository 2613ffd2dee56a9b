"""One-hot labels, their products, and the indices made of them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import col, flag, ratio, zero

# The label sets of the two scorers.
SENTIMENTS = ("negative", "neutral", "positive")
CREDIBILITY = ("LABEL_0", "LABEL_1")

PRODUCTS = (
    "positive_label_1", "negative_label_1", "positive_label_0", "negative_label_0",
    "rel_pos_label_1", "rel_neg_label_1", "rel_pos_label_0", "rel_neg_label_0",
)


def one_hot(df: DataFrame, sentiment: str = "finbert", credibility: str = "fakebert") -> DataFrame:
    """0/1 columns for the fixed label sets."""
    made = {v: flag(F.col(sentiment) == v) for v in SENTIMENTS}
    made |= {v.lower(): flag(F.col(credibility) == v) for v in CREDIBILITY}
    return df.withColumns(made)


def categories(df: DataFrame, column: str) -> list:
    """The distinct values of a label column, in order.

    They become column names, which the plan holds in any case. For columns
    with very many values, `indexed` gives one vector column instead.
    """
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def one_hot_learned(df: DataFrame, *columns: str) -> DataFrame:
    """0/1 columns for the values found in the data."""
    made = {v.lower(): flag(F.col(c) == v) for c in columns for v in categories(df, c)}
    return df.withColumns(made)


def indexed(df: DataFrame, column: str, out: str) -> DataFrame:
    """A sparse 0/1 vector over all values found, however many; a missing value has none set."""
    index = StringIndexer(inputCol=column, outputCol="_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCol="_index", outputCol=out, dropLast=True)
    return Pipeline(stages=[index, hot]).fit(df).transform(df).drop("_index")


def interactions(df: DataFrame, rel_pos: str = "positive", rel_neg: str = "negative") -> DataFrame:
    """Sentiment times credibility, and the same for relevance.

    Relevance falls back to a copy of sentiment when no columns are named.
    """
    sides = {"positive": "positive", "negative": "negative", "rel_pos": rel_pos, "rel_neg": rel_neg}
    made = {}
    for label in ("label_1", "label_0"):
        for name, source in sides.items():
            made[f"{name}_{label}"] = F.col(source) * F.col(label)
    return df.withColumns(made)


def times(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`<column>_<key>` = key times column, for every listed column."""
    return df.withColumns({f"{c}_{key}": F.col(key) * F.col(c) for c in columns})


def balance(pos: str | Column, neg: str | Column) -> Column:
    """(pos - neg) / (pos + neg), null when both are 0."""
    p, n = col(pos), col(neg)
    return ratio(p - n, p + n)


def balance_indices(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """`<pos>_index` = balance / 10 for each (pos, neg) pair."""
    return df.withColumns({f"{p}_index": balance(p, n) / 10 for p, n in pairs})


def true_fake_indices(df: DataFrame, uncert: str = "uncert", illiq: str = "illiq") -> DataFrame:
    """True and fake balance, plain and relevance, times a tenth of each state."""
    plain = {
        "true_index": balance("positive_label_1", "negative_label_1"),
        "fake_index": balance("positive_label_0", "negative_label_0"),
        "rel_true_index": balance("rel_pos_label_1", "rel_neg_label_1"),
        "rel_fake_index": balance("rel_pos_label_0", "rel_neg_label_0"),
    }
    out = df.withColumns({uncert: F.col(uncert) / 10, illiq: F.col(illiq) / 10}).withColumns(plain)
    states = [uncert, illiq]
    names = list(plain) + list(PRODUCTS)
    return out.withColumns({f"{s}_{n}": F.col(s) * F.col(n) for s in states for n in names})


def shares_of_mentions(df: DataFrame) -> DataFrame:
    """Label-0 counts as what label 1 leaves, and each count over all mentions."""
    left = {
        "positive_label_0": F.col("positive") - F.col("positive_label_1"),
        "negative_label_0": F.col("negative") - F.col("negative_label_1"),
    }
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    rel = {
        f"rel_{short}_label_{k}": zero(ratio(f"{full}_label_{k}", total))
        for k in (1, 0)
        for short, full in (("pos", "positive"), ("neg", "negative"))
    }
    return df.withColumns(left).withColumns(rel)


def fold_rare(df: DataFrame, column: str, threshold: int = 10, other: str = "Other") -> DataFrame:
    """Values seen `threshold` times or less become `other`.

    Only the frequent values are joined back. The counted side is small enough
    to broadcast or not; the plan checks before it says so.
    """
    from tidemark.session import sized

    frequent = df.groupBy(column).count().where(F.col("count") > threshold).select(F.col(column).alias("_kept"))
    joined = df.join(sized(frequent), F.col(column) == F.col("_kept"), "left")
    folded = F.when(F.col(column).isNull() | F.col("_kept").isNotNull(), F.col(column)).otherwise(F.lit(other))
    return joined.withColumn(column, folded).drop("_kept")
