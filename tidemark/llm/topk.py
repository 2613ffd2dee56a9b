"""Exact top-k search by columnar branch and bound.

Candidates lie in blocks, one dimension after the other (vertical layout). A
query meets a block at the dimensions where the query is largest: scores are
summed block of dimensions by block of dimensions, what the remaining ones can
still add is bounded by the remaining mass of both vectors, and candidates that
can no longer be among the k best are left out before the next dimensions are
read. Scores are sums of integers, so the bounds lose nothing.

Every query row visits every block of candidates: rows are not paired before
they meet. Blocks hold about `block_rows` candidates; queries stream past.

Rows are told apart by themselves: rows that repeat a vec_id all count, as candidates
and as queries, and a query leaves out its own row only. Vectors that are null or hold
null or non-finite components take no part; a shorter vector counts as filled up with
zeros. Ties go to the smaller vec_id, a null one coming last. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.rows import embeddings
from tidemark.session import cut_lineage

BLOCK_ROWS, DIMS_AT_ONCE = 8192, 16
FOUND = pa.schema([(n, pa.int64()) for n in ("query_row", "query_id", "vec_id", "row", "score")])
NO_ID = np.iinfo(np.int64).max  # stands for a null vec_id, which comes last


FINE = (
    "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
)


def valid_rows(df: DataFrame) -> DataFrame:
    """row, vec_id and embedding of all rows that take part; stored, so that the row's number stays."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "embedding")
    return cut_lineage(rows.where(FINE))


def matrix(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Rows of one length, filled up with zeros."""
    width = max([width, *map(len, vectors)], default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


class CandidateBlock:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: list[np.ndarray]):
        self.ids, self.rows = ids, rows
        self.columns = np.ascontiguousarray(np.floor(64 * matrix(vectors)).T)
        self.squares = self.columns**2
        self.mass = self.squares.sum(axis=0)

    def best(self, query_row: int, query: np.ndarray, k: int, dims_at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates but the query's own row, best first."""
        q = np.zeros(len(self.columns))
        q[: min(len(query), len(q))] = np.floor(64 * query[: len(q)])
        alive = np.flatnonzero(self.rows != query_row)
        score, mass = np.zeros(len(alive)), self.mass[alive]
        order = np.argsort(-np.abs(q), kind="stable")
        for at in range(0, len(order), dims_at_once):
            if not len(alive):
                break
            dims = order[at : at + dims_at_once]
            whole = len(alive) == self.columns.shape[1]
            part = self.columns[dims] if whole else self.columns[np.ix_(dims, alive)]
            score = score + q[dims] @ part
            mass = mass - (self.squares[dims].sum(axis=0)[alive] if whole else (part**2).sum(axis=0))
            rest = order[at + dims_at_once :]
            if len(alive) > k and len(rest):
                # One unit of slack covers the rounding of the root.
                reach = np.sqrt(np.maximum(mass, 0) * (q[rest] ** 2).sum()) + 1
                least = np.partition(score - reach, len(alive) - k)[len(alive) - k]
                keep = score + reach >= least
                alive, score, mass = alive[keep], score[keep], mass[keep]
        top = np.lexsort((self.rows[alive], self.ids[alive], -score))[:k]
        return alive[top], score[top].astype(np.int64)


def _search_rows(batches, k, dims_at_once):
    """Rows come by block, candidates before queries."""
    current, ids, rows, vectors, block = None, [], [], [], None
    for b in batches:
        found = []
        values = b.column(4).values.to_numpy(zero_copy_only=False).astype(float)
        ends = b.column(4).offsets.to_numpy()
        for i, (cell, is_query, row, vec_id) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)))):
            v = values[ends[i] : ends[i + 1]]
            if cell != current:
                current, ids, rows, vectors, block = cell, [], [], [], None
            if not is_query:
                ids.append(NO_ID if vec_id is None else vec_id)
                rows.append(row)
                vectors.append(v.copy())
                continue
            if block is None:
                block = CandidateBlock(np.array(ids, dtype=np.int64), np.array(rows, dtype=np.int64), vectors)
            near, score = block.best(row, v, k, dims_at_once)
            own = (np.full(len(near), x) for x in (row, vec_id))
            found.append((*own, block.ids[near], block.rows[near], score))
        if found:
            columns = [np.concatenate(c) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=c == NO_ID if n == 2 else None) for n, c in enumerate(columns)], schema=FOUND)


def search(
    candidates: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, dims_at_once: int = DIMS_AT_ONCE
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates; both sides as of `valid_rows`."""
    cells = max(1, math.ceil(candidates.count() / block_rows))
    cell = F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int")
    stored = candidates.select(cell.alias("cell"), F.lit(False).alias("is_query"), "row", "vec_id", "embedding")
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
    asked = queries.select(every, F.lit(True).alias("is_query"), "row", "vec_id", "embedding")
    found = (
        stored.unionByName(asked)
        .repartition("cell")
        .sortWithinPartitions("cell", "is_query")
        .mapInArrow(partial(_search_rows, k=k, dims_at_once=dims_at_once), ", ".join(f"{n} long" for n in FOUND.names))
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op6_topk_bound(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 candidates with the highest integer inner product for every 20th vector."""
    rows = valid_rows(embeddings(spark, folder))
    return search(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


SQL = """
WITH fine AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, c.r, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1),
    lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND c.r <> q.r),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, r))::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
