"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. A first graph comes from `trees` random hyperplane
partitions: within a cell every node meets every other, and cells of more than
`leaf_rows` nodes are dealt into parts. Then the graph is improved by joins of
neighbours of neighbours: around every node, all its neighbours in either
direction are compared with each other, and pairs nearer than what they had so
far become links. Nodes are worked on in blocks of one partition, and a vector
travels once to each block that needs it.

A query starts at its own node and at `seeds` common ones. In each round the
unvisited nodes among its `beam` nearest are opened: a join gives their
neighbours, blocks of nodes give the distances, and the best `beam` stay; it
ends when no query has a node left to open. The nearest found are ranked by the
exact distance of the original vectors, in double precision.

Rows are told apart by themselves: rows that repeat a vec_id all count, as candidates
and as queries, and a query leaves out its own row only. Vectors that are null, zero
or hold null or non-finite components take no part; a shorter vector counts as filled
up with zeros. Ties go to the smaller vec_id, a null one coming last, also between
copies. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.rows import embeddings, small_batches
from tidemark.llm.topk import matrix, valid_rows
from tidemark.session import cut_lineage

NEIGHBOURS, TREES, LEAF_ROWS, ROUNDS = 32, 6, 512, 2
# A block of pivots gets each vector it needs once: at most 2 * NEIGHBOURS + 1 a pivot, less where pivots share them.
# Large blocks need nearly every node, so that copies grow with the number of blocks; small ones are bound by neighbours.
PIVOT_ROWS = 512
BEAM, SEEDS, BLOCK_ROWS = 256, 64, 4096
LINKS = "u long, v long, d float"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to all rows of `b`."""
    out = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)


def _vectors(column) -> np.ndarray:
    """An Arrow or pandas column of arrays as one matrix."""
    return matrix([np.asarray(v, dtype=float) for v in column]).astype(np.float32)


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, embedding) of distinct vectors, named by their least row; (node, row, vec_id) of all rows."""
    nodes = cut_lineage(vectors.groupBy("embedding").agg(F.min("row").alias("node")).select("node", "embedding"))
    return nodes, vectors.join(nodes, "embedding").select("node", "row", "vec_id")


# The first graph


def _cell_rows(batches, trees, depth, seed):
    """Each node once per tree with the signs of `depth` random projections."""
    for b in small_batches(batches, 4 << 20):
        x = _vectors(b.column(1).to_pylist())
        for tree in range(trees):
            planes = np.zeros((depth, x.shape[1]))
            for k in range(depth):
                planes[k] = np.random.default_rng((seed, tree, k)).normal(size=x.shape[1])
            cell = ((x @ planes.T) > 0) @ (1 << np.arange(depth))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), tree, np.int32)), pa.array(cell.astype(np.int64)), b.column(0), b.column(1)],
                names=["tree", "cell", "node", "embedding"],
            )


def nearest_links(ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of each row among the others."""
    k = min(k, len(ids) - 1)
    if k < 1:
        return pd.DataFrame({"u": [], "v": [], "d": []}).astype({"u": "int64", "v": "int64", "d": "float32"})
    parts = []
    for at in range(0, len(ids), 512):
        d = distances(x[at : at + 512], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        parts.append((np.repeat(ids[at : at + 512], k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()))
    u, v, d = (np.concatenate(c) for c in zip(*parts))
    return pd.DataFrame({"u": u, "v": v, "d": d.astype(np.float32)})


def _cell_links(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return nearest_links(rows["node"].to_numpy(), _vectors(rows["embedding"]), k)


def keep_nearest(links: DataFrame, k: int) -> DataFrame:
    one = links.groupBy("u", "v").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def first_graph(nodes: DataFrame, n: int, k: int, trees: int, leaf_rows: int, seed: int = 11) -> DataFrame:
    depth = min(40, max(0, math.ceil(math.log2(max(1, n) / leaf_rows))))
    cells = cut_lineage(
        nodes.mapInArrow(
            partial(_cell_rows, trees=trees, depth=depth, seed=seed),
            "tree int, cell long, node long, embedding array<float>",
        )
    )
    # Cells are as uneven as the vectors: the large ones are dealt into parts by a hash.
    sizes = cells.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(2 * leaf_rows))).alias("parts"))
    parts = cells.join(cut_lineage(sizes), ["tree", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("node", "tree"), F.col("parts"))
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _cell_links(rows, k)

    links = parts.groupBy("tree", "cell", "part").applyInPandas(run, LINKS)
    return cut_lineage(keep_nearest(links, k))


# Neighbours of neighbours


def _around_rows(batches, k):
    """Blocks of pivots: members' vectors first, then (pivot, members); gives links nearer than known."""

    def work(members, pivots):
        members = pd.concat(members, ignore_index=True)
        ids, x = members["member"].to_numpy(), _vectors(members["embedding"])
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        worst = members["worst"].to_numpy()[order]
        found = []

        def best():
            a, b, d = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((d, b, a))
            a, b, d = a[order], b[order], d[order]
            fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            a, b, d = a[fresh], b[fresh], d[fresh]
            order = np.lexsort((d, a))
            a, b, d = a[order], b[order], d[order]
            begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            place = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
            return a[place < k], b[place < k], d[place < k]

        held = 0
        for own in pivots:
            at = np.searchsorted(ids, own)
            d = distances(x[at], x[at])
            near = d < worst[at][:, None]
            near[np.arange(len(at)), np.arange(len(at))] = False
            i, j = np.nonzero(near)
            found.append((at[i], at[j], d[i, j]))
            held += len(i)
            if held > 2_000_000:
                found, held = [best()], 0
        if found:
            a, b, d = best()
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(d.astype(np.float32))], names=["u", "v", "d"])
        return None

    block, members, pivots = None, [], []
    for batch in batches:
        rows = batch.to_pandas()
        for key, part in rows.groupby("block", sort=False):
            if key != block:
                if pivots and (out := work(members, pivots)) is not None:
                    yield out
                block, members, pivots = key, [], []
            is_member = part["members"].isna()
            if is_member.any():
                members.append(part.loc[is_member, ["member", "embedding", "worst"]])
            pivots += [np.asarray(m, dtype=np.int64) for m in part.loc[~is_member, "members"]]
    if pivots and (out := work(members, pivots)) is not None:
        yield out


def improve(nodes: DataFrame, links: DataFrame, n: int, k: int, block_rows: int, seed: int = 11) -> DataFrame:
    """One round: every node's neighbours, in both directions, meet each other."""
    # The k nearest of those that point at a node: a node that many point at meets no more of them.
    back = keep_nearest(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"), k)
    around = links.select("u", "v").union(back.select("u", "v")).distinct()
    depth = min(40, max(0, math.ceil(math.log2(max(1, n) / block_rows))))
    cells = nodes.mapInArrow(
        partial(_cell_rows, trees=1, depth=depth, seed=seed), "tree int, cell long, node long, embedding array<float>"
    )
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(2 * block_rows))).alias("parts"))
    block = F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.col("parts")))
    blocks = cut_lineage(cells.select("node", "cell").join(sizes, "cell").select(F.col("node").alias("u"), block.alias("block")))
    pairs = cut_lineage(around.join(blocks, "u").select("block", F.col("u").alias("pivot"), F.col("v").alias("member")))
    full = links.groupBy("u").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"))
    worst = F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf")).cast("float"))
    known = nodes.join(full, nodes.node == full.u, "left").select(
        "node", "embedding", F.coalesce(worst, F.lit(float("inf")).cast("float")).alias("worst")
    )
    wanted = pairs.select("block", "member").union(pairs.select("block", F.col("pivot"))).distinct()
    carried = wanted.join(known, wanted.member == known.node).select(
        "block", F.lit(0).alias("kind"), "member", "embedding", "worst", F.lit(None).cast("array<bigint>").alias("members")
    )
    # At most 2k members and the pivot itself.
    meetings = pairs.groupBy("block", "pivot").agg(F.collect_list("member").alias("members")).select(
        "block", F.lit(1).alias("kind"), F.col("pivot").alias("member"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("float").alias("worst"),
        F.concat("members", F.array("pivot")).alias("members"),
    )
    new = (
        carried.unionByName(meetings)
        .repartition("block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(partial(_around_rows, k=k), LINKS)
    )
    return cut_lineage(keep_nearest(links.union(new), k))


def build(
    nodes: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, leaf_rows: int = LEAF_ROWS, rounds: int = ROUNDS,
    block_rows: int = PIVOT_ROWS,
) -> DataFrame:
    """Links u, v, d (squared) of each node to about its k nearest."""
    n = nodes.count()
    links = first_graph(nodes, n, k, trees, leaf_rows)
    for _ in range(rounds):
        links = improve(nodes, links, n, k, block_rows)
    return links


# Queries


def _distance_rows(batches):
    """Blocks of nodes first, then queries with the nodes of the block that they ask for."""
    block, ids, vectors, x = None, [], [], None
    for b in batches:
        out = []
        cells, kinds, keys = (b.column(i).to_pylist() for i in range(3))
        embedding, asked = b.column(3), b.column(4)
        for i, (cell, kind, key) in enumerate(zip(cells, kinds, keys)):
            if cell != block:
                block, ids, vectors, x = cell, [], [], None
            v = np.asarray(embedding[i].values.to_numpy(zero_copy_only=False), dtype=float)
            if kind == 0:
                ids.append(key)
                vectors.append(v)
                continue
            if x is None:
                order = np.argsort(ids)
                names = np.array(ids, dtype=np.int64)[order]
                x = matrix([vectors[o] for o in order], len(v)).astype(np.float32)
            wanted = asked[i].values.to_numpy(zero_copy_only=False)
            q = np.zeros(x.shape[1], np.float32)
            q[: min(len(v), len(q))] = v[: len(q)]
            d = ((x[np.searchsorted(names, wanted)] - q) ** 2).sum(axis=1)
            out.append((np.full(len(wanted), key), wanted, d.astype(np.float32)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "node", "d"])


def measure(asked: DataFrame, queries: DataFrame, nodes: DataFrame, blocks: int) -> DataFrame:
    """Squared distances of (query_id, node) pairs; a query's vector travels once per block."""
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    lists = asked.groupBy("query_id", block.alias("block")).agg(F.collect_list("node").alias("asked"))
    rows = lists.join(queries, "query_id").select(
        "block", F.lit(1).alias("kind"), F.col("query_id").alias("key"), "embedding", "asked"
    )
    stored = nodes.select(
        block.alias("block"), F.lit(0).alias("kind"), F.col("node").alias("key"), "embedding",
        F.lit(None).cast("array<bigint>").alias("asked"),
    )
    return (
        stored.unionByName(rows)
        .repartition("block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(_distance_rows, "query_id long, node long, d float")
    )


def search(
    queries: DataFrame, starts: DataFrame, nodes: DataFrame, links: DataFrame, beam: int = BEAM, seeds: int = SEEDS
) -> DataFrame:
    """query_id, node and d of the `beam` nearest nodes found for queries (query_id, embedding).

    `starts` are (query_id, node) to begin with, beside the common seeds.
    """
    blocks = max(1, math.ceil(nodes.count() / BLOCK_ROWS))
    back = keep_nearest(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"), NEIGHBOURS)
    ways = cut_lineage(links.select("u", "v").union(back.select("u", "v")).distinct())
    common = [r["node"] for r in nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(seeds).collect()]
    asked = starts
    if common:
        seeded = queries.select("query_id", F.explode(F.array(*map(F.lit, common)).cast("array<bigint>")).alias("node"))
        asked = starts.union(seeded).distinct()
    best = None
    while True:
        got = measure(asked, queries, nodes, blocks).withColumn("open", F.lit(True))
        if best is not None:
            got = best.withColumn("open", F.lit(False)).unionByName(got)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "node"))
        best = cut_lineage(got.withColumn("rank", rank).where(F.col("rank") <= beam).drop("rank"))
        opened = best.where("open")
        if opened.isEmpty():
            return best.select("query_id", "node", "d")
        found = opened.join(ways, opened.node == ways.u).select("query_id", F.col("v").alias("node")).distinct()
        best = best.drop("open")
        asked = cut_lineage(found.join(best.select("query_id", "node"), ["query_id", "node"], "left_anti"))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found; `queries` are rows of `vectors`, which are as of `valid_rows`."""
    nodes, members = nodes_of(vectors)
    members = cut_lineage(members)
    links = build(nodes, neighbours, rounds=rounds)
    asked = queries.select(F.col("row").alias("query_id"), "embedding", F.col("vec_id").alias("named"))
    starts = members.select(F.col("row").alias("query_id"), "node").join(asked.select("query_id"), "query_id")
    found = search(asked.drop("named"), starts, nodes, links, beam)
    # Of copies, k + 1 can be among the k nearest or be the query itself.
    least = F.asc_nulls_last("vec_id")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(least, "row"))
    few = members.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
    a, b = F.col("a"), F.col("b")
    gap = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y.cast("double"), F.lit(0.0)))
    score = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
    scored = (
        found.join(asked.withColumnRenamed("embedding", "a"), "query_id")
        .join(nodes.withColumnRenamed("embedding", "b"), "node")
        .select("query_id", "named", "node", score.alias("score"))
    )
    rows = scored.join(few, "node").where("row <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", least, "row"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("named").alias("query_id"), "rank", "vec_id", "score")


def op10_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest found for every 100th vector."""
    vectors = cut_lineage(valid_rows(embeddings(spark, folder)).where("exists(embedding, x -> x <> 0)"))
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)
