"""A lookup join that no hot key can overload."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_KEYS = 10_000
HOT_FROM = 100_000
SALTS = 1024


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], size: str, spread: list[str]) -> DataFrame:
    """`rows` with the columns of `side` for their key; rows without a match drop out.

    `side` has one row per key and `size`, how many rows have it (or a number
    in proportion). The largest keys are broadcast, 10,000 at most, so any
    other key has less than a 10,000th of all rows. Those join by shuffle, and
    the rows of hot keys, already served, take part under a salt made from
    `spread` that matches nothing, so they stay evenly spread.
    """
    values = [c for c in side.columns if c not in keys]
    packed = side.select(*keys, F.struct(*values).alias("_side"), F.col(size).alias("_size"))
    hot = packed.where(F.col("_size") > HOT_FROM).orderBy(F.desc("_size")).limit(HOT_KEYS)
    hot = hot.select(*keys, F.col("_side").alias("_hot"))
    cold = packed.select(*keys, "_side", F.lit(0).alias("_salt"))
    served = rows.join(F.broadcast(hot), keys, "left")
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    joined = served.withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    found = joined.withColumn("_side", F.coalesce("_hot", "_side")).where(F.col("_side").isNotNull())
    return found.select(*rows.columns, *[F.col("_side")[c].alias(c) for c in values])
