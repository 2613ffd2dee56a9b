"""Exact ranks, running totals and quantiles that never sort a whole group in one task.

A window over a hot key would put all of that key's rows on one executor. Here
every group is cut into ordered buckets first. Counts per (group, bucket) are
small and give each bucket its starting point; only the rows of one bucket are
ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import cut_lineage

HASH_BUCKETS_HEX = 4  # first hex digits of an md5: 65,536 even buckets per group
BUCKET_POINTS = 200_000  # points that are sorted together


def hash_key(c: str | Column) -> Column:
    """A repeatable shuffle order: the md5 of the value as text."""
    return F.md5(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


def hash_bucket(c: str | Column) -> Column:
    return F.substring(hash_key(c), 1, HASH_BUCKETS_HEX)


def ranked(df: DataFrame, by: list[str], order: list, bucket: Column, name: str = "pos", total: str | None = None) -> DataFrame:
    """`name` = 1-based exact position of each row within its group.

    `bucket` must rise with the order: rows of a lower bucket come first. The
    row numbering and the join of the offsets share one shuffle, keyed by
    (group, bucket). `total`, if named, gets the size of the group. Rows whose
    group key is missing belong to no group and are left out.
    """
    keys = by + ["_bucket"]
    rows = df.withColumn("_bucket", bucket)
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    extra = [F.sum("_n").over(group).alias(total)] if total else []
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *extra)
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    numbered = rows.withColumn("_in", within).join(offsets, keys)
    return numbered.withColumn(name, F.col("_before") + F.col("_in")).drop("_bucket", "_in", "_before")


def key_positions(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """1-based position of every distinct key in sorted order, over all keys."""
    keys = df.select(key).distinct()
    points = totals_below(keys.withColumn("_one", F.lit(1)), [], key, ["_one"])
    return points.select(key, (F.col("_one_below") + 1).alias(name))


def group_sizes(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def _with_buckets(points: DataFrame, by: list[str], key: str, bucket_points: int) -> DataFrame:
    """Points in ordered buckets of about `bucket_points`: ranges over group and key, as many as the points need.

    The bucket is the range's number. It is stored with the rows, so that it
    stays what it was when a task is repeated.
    """
    points = cut_lineage(points)
    ranges = max(1, -(-points.count() // bucket_points))
    dealt = points.repartitionByRange(ranges, *by, key)
    return cut_lineage(dealt.withColumn("_bucket", F.spark_partition_id()))


def totals_below(
    points: DataFrame, by: list[str], key: str, measures: list[str], bucket_points: int = BUCKET_POINTS
) -> DataFrame:
    """`<m>_below` = total of each measure over smaller keys, `<m>_total` = over all.

    `points` holds one row per (group, key value), so a value shared by many
    rows is one point. The totals are exact wherever the borders of the
    buckets fall.
    """
    keys = by + ["_bucket"]
    rows = _with_buckets(points, by, key, bucket_points)
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    sums = sums.select(
        *keys,
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}_b") for m in measures],
        *[F.sum(f"_{m}").over(group).alias(f"{m}_total") for m in measures],
    )
    inside = W.partitionBy(*keys).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"_{m}_i": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}).join(sums, keys)
    rows = rows.withColumns({f"{m}_below": F.col(f"_{m}_i") + F.col(f"_{m}_b") for m in measures})
    return rows.drop("_bucket", *[f"_{m}_{s}" for m in measures for s in "ib"])


def quantiles(
    df: DataFrame, by: list[str], value: str, at: dict[str, float], bucket_points: int = BUCKET_POINTS
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per name.

    Equal values are counted before anything is ordered, so neither a hot group
    nor a hot value lands in one task.
    """
    points = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranks = totals_below(points, by, value, ["n"], bucket_points)
    out = []
    for name, q in at.items():
        spot = (F.col("n_total") - 1) * F.lit(float(q))
        low, high = F.floor(spot), F.ceil(spot)
        covers = lambda i: (F.col("n_below") <= i) & (i < F.col("n_below") + F.col("n"))
        at_low = F.max(F.when(covers(low), F.col(value)))
        at_high = F.max(F.when(covers(high), F.col(value)))
        out.append((at_low + (at_high - at_low) * F.max(spot - low)).alias(name))
    return ranks.groupBy(*by).agg(*out)


def balanced_sample(df: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of every class as the smallest class has, repeatably."""
    smallest = group_sizes(df, [label], "_n").agg(F.min("_n"))
    rows = ranked(df, [label], [hash_key(key), key], hash_bucket(key), "_pos")
    return rows.where(F.col("_pos") <= smallest.scalar()).drop("_pos")


def split(df: DataFrame, key: str, test_fraction: float, label: str | None = None, out: str = "split") -> DataFrame:
    """Exact train/test split: ceil(fraction * n) test rows, per class if one is named."""
    rows = ranked(df, [label] if label else [], [hash_key(key), key], hash_bucket(key), "_pos", "_n")
    is_test = F.col("_pos") <= F.ceil(F.col("_n") * F.lit(float(test_fraction)))
    return rows.withColumn(out, F.when(is_test, "test").otherwise("train")).drop("_pos", "_n")


def folds(df: DataFrame, key: str, label: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Fold numbers 0..k-1, dealt out evenly within each class."""
    rows = ranked(df, [label], [hash_key(key), key], hash_bucket(key), "_pos")
    return rows.withColumn(out, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of every group.

    Spark cuts each input partition to k rows per group before the shuffle, so
    a hot group sends little.
    """
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def latest(df: DataFrame, n: int, *order) -> DataFrame:
    """The last n rows overall: each partition keeps n, then one merge."""
    return df.orderBy(*order).limit(n)
