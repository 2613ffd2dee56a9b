"""Clusters of dense vectors by an exact join of slices.

Unit vectors within a radius of each other are within it along any one
direction as well. Each block is cut into slices of that width along a fixed
direction; a vector goes to its own slice and, as a visitor, to the next one,
so it is placed twice whatever the radius. Large slices are cut into parts that
meet two by two, so a task sees a bounded number of rows, and a task reports
only the links that connect its own vectors, never all near pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.components import components
from tidemark.operators.spread import spread_join
from tidemark.session import cut_lineage

SEED = 42


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _stack(column: pd.Series) -> np.ndarray:
    return _unit(np.vstack(column.to_numpy()).astype(np.float64))


def _local_roots(near: np.ndarray) -> np.ndarray:
    """The smallest row number each row is connected to."""
    label = np.arange(len(near))
    while True:
        reached = np.where(near, label[None, :], len(near)).min(axis=1)
        new = np.minimum(label, reached)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _assign(radius: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = _stack(pdf["v"])
            # A zero vector is at distance 1 from all in cosine terms: near nobody.
            alive = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
            along = np.random.default_rng(SEED).normal(size=x.shape[1])
            home = np.floor(x[alive] @ (along / np.linalg.norm(along)) / radius).astype(np.int64)
            row = np.concatenate([alive, alive])
            yield pd.DataFrame({
                "block": pdf["block"].to_numpy()[row], "cell": np.concatenate([home, home + 1]),
                "id": pdf["id"].to_numpy()[row], "home": np.concatenate([home, home]), "v": pdf["v"].to_numpy()[row],
            })

    return run


def _links(eps: float):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        cell, a, b = key[1], key[2], key[3]
        pdf = pdf.sort_values("id", ignore_index=True)
        x = _stack(pdf["v"])
        home, part = pdf["home"].to_numpy(), pdf["part"].to_numpy()
        at_home = home == cell
        near = (1.0 - x @ x.T) <= eps + 1e-12
        # Home rows meet each other and the visitors; visitors have met at home.
        near &= at_home[:, None] | at_home[None, :]
        if a != b:
            near &= part[:, None] != part[None, :]
        np.fill_diagonal(near, False)
        root = _local_roots(near)
        moved = root != np.arange(len(root))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"u": ids[moved], "v": ids[root[moved]]})

    return run


def vector_links(vectors: DataFrame, eps: float, part_rows: int) -> DataFrame:
    """(u, v) links that connect vectors within cosine distance eps of a block.

    `vectors` has block, id, v, one row per distinct vector.
    """
    kinds = dict(vectors.dtypes)
    # A little wider than the radius, for what rounding moves over a border.
    width = max(float(np.sqrt(2 * eps)), 1e-6) * (1 + 1e-9) + 1e-9
    placed = vectors.mapInPandas(
        _assign(width), f"block {kinds['block']}, cell long, id {kinds['id']}, home long, v {kinds['v']}"
    )
    placed = cut_lineage(placed)
    sizes = placed.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("_m"))
    sizes = sizes.select("block", "cell", F.ceil(F.col("_m") / part_rows).cast("int").alias("parts"))
    rows = placed.join(sizes, ["block", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("_o", other).withColumns({"a": F.least("part", "_o"), "b": F.greatest("part", "_o")})
    tasks = rows.select("block", "cell", "a", "b", "id", "home", "part", "v")
    return tasks.groupBy("block", "cell", "a", "b").applyInPandas(
        _links(eps), f"u {kinds['id']}, v {kinds['id']}"
    ).distinct()


def vector_clusters(
    df: DataFrame, key: str, vector: str, block: str, eps: float, part_rows: int = 2_000
) -> DataFrame:
    """(key, block, cluster): the smallest id of the cluster, or -1 for a lone vector.

    Equal vectors are one before any comparison, however many there are.
    """
    rows = df.select(F.col(block).alias("block"), F.col(key).alias("id"), F.col(vector).alias("v"))
    reps = rows.groupBy("block", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n"))
    reps = cut_lineage(reps)
    links = vector_links(reps.select("block", F.col("rep").alias("id"), "v"), eps, part_rows)
    roots = components(links.withColumn("g", F.lit(0))).select(F.col("node").alias("rep"), "root")
    some = F.exists("v", lambda x: x != 0)
    labels = reps.join(roots, "rep", "left").select(
        "block", "v",
        F.when(F.col("root").isNotNull(), F.col("root"))
        .when((F.col("_n") > 1) & some, F.col("rep"))
        .otherwise(F.lit(-1))
        .alias("cluster"),
        "_n",
    )
    return spread_join(rows, labels, ["block", "v"], "_n", ["id"]).select(F.col("id").alias(key), F.col("block").alias(block), "cluster")
