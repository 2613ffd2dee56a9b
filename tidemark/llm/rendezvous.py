"""Sharding by rendezvous hashing.

Every shard draws a number for a record's key, and the shard with the highest
one takes the record; a shard of weight w raises its draw to the power 1/w. A
further shard takes over just the records for which its draw is the highest,
and no record moves between the old shards.

A record's slot counts up from 0 in its shard, in order of doc_id (nulls first),
size and checksum. Records are dealt by range over all three and a tie breaker,
so that no task holds a whole shard or all rows of one doc_id; slots come from
counts per range.

Null text has size 1 and the checksum of no bytes; a null doc_id is a key of
its own. Rows that repeat share the shard and get slots of their own. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.rows import documents
from tidemark.session import cut_lineage

HEX = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def _draw(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    number = F.conv(F.substring(digest, 1, HEX), 16, 10).cast("double")
    share = (number + 0.5) / F.lit(float(16**HEX))
    return share if weight == 1 else F.pow(share, F.lit(1 / weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that takes a string key; equal draws go to the lowest shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    draws = [_draw(key, j, w) for j, w in enumerate(weights)]
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return F.coalesce(*(F.when(d == best, F.lit(j)) for j, d in enumerate(draws)))


def assign(df: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the shard under the weights `grown`."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = df.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, grown).alias("grown_shard"),
    )
    order = ["doc_id", "size", "text_crc32"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie")
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()))
    # One row per range and shard: few, so they are added up per shard.
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut_lineage(counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")))
    place = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order))
    return (
        dealt.withColumn("place", place)
        .join(firsts, ["shard", "part"])
        .select(*order, "shard", (F.col("first") + F.col("place") - 1).alias("slot"), "grown_shard")
    )


def op4_rendezvous(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of equal weight, and where each goes with a ninth."""
    placed = assign(documents(spark, folder), [1.0] * 8, [1.0] * 9)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql() -> str:
    draw = lambda j: f"md5(k || ':{j}')[1:{HEX}]"  # noqa: E731  of equal length, so text order is number order
    case = lambda n: "CASE greatest(" + ", ".join(map(draw, range(n))) + ") " + " ".join(f"WHEN {draw(j)} THEN {j}" for j in range(n)) + " END"
    return f"""
WITH bits AS (SELECT range AS i, range AS c0 FROM range(256)),
steps AS (SELECT list(c8 ORDER BY i) AS t FROM (
  SELECT i, list_reduce([c0] || [0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c8 FROM bits)),
base AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    hex(encode(coalesce(text, ''))) AS h FROM documents),
hashed AS (
  SELECT doc_id, size,
    {case(8)} AS shard, {case(9)} AS grown_shard,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, size - 1), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
  FROM base, steps)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM hashed"""


SQL = _sql()
