"""Connected components by alternating star rounds.

Large-star and small-star (Kiveris et al., 2014): every round hangs neighbours
on the smallest node they know, and the edge set ends as one star per
component. A round is two grouped minima and two joins, whatever the length of
the chains; each round is stored, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.spread import spread_join
from tidemark.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("g", "u", "v").union(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("g", "u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    hung = spread_join(both.where(F.col("v") > F.col("u")), least, ["g", "u"], "n", ["v"])
    return hung.select("g", F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges point from the larger node to the smaller one.
    down = edges.select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("g", "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hung = spread_join(down, least, ["g", "u"], "n", ["v"]).where(F.col("v") != F.col("m"))
    hung = hung.select("g", F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("g", "u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame):
    """A fingerprint of the edge set, to see that a round changed nothing."""
    h = F.xxhash64("g", "u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum((h % 1_000_003).cast("decimal(38,0)")), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """(g, node, root): the smallest node of each component, per graph g.

    `edges` has g, u, v with u and v differing; nodes without an edge do not
    appear.
    """
    current = cut_lineage(_small_star(edges.where("u <> v")))
    seen = _mark(current)
    while True:  # the rounds end: every one that changes something brings nodes nearer to their root
        current = cut_lineage(_small_star(_large_star(current)))
        now = _mark(current)
        if now == seen:
            break
        seen = now
    members = current.select("g", F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select("g", F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return members.union(roots)
