"""Vector code compression: codebooks trained through lexicographic tries.

Components become integers, floor(scale * x), and vectors are cut into equal
consecutive parts. A part position has a codebook of `entries` parts, at first
those of the vectors with the smallest ids. A round assigns each part to its
nearest entry and replaces every entry by the floored mean of its parts.

Equal parts are one: distinct parts and their numbers are counted once, put in
lexicographic order over ranges, and stored. In a range they form a trie whose
nodes are prefixes. It is walked depth first: a node carries the vector of its
prefix's squared distances to all entries, children add one dimension to it, and
leaves take the least entry and add their components, weighted by their number, to
that entry's sums. A round shuffles only those sums, at most one row per task and
entry, and the codebooks, `parts * entries` rows, are all that the driver holds.
At the end rows are coded where they lie, through tries of their own batch: no row
travels to its parts, so a vector that a third of all rows share costs nothing more.

Rows whose vector is null or holds a null or non-finite component go; a null
vec_id or label stays, null ids being the largest. Among equal ids the smaller
vector comes first. Vectors are filled up with zeros to the longest one and to a
multiple of `parts`. Integers beyond 2**27 in size count as 2**27, so that sums
stay within a long; a label's error beyond a long is null. With fewer vectors than
entries the codebook is as long as there are vectors. Equal entries: the first one
counts. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.rows import embeddings, small_batches
from tidemark.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 27
LEAVES_AT_ONCE = 2048
RANGE_PARTS = 100_000  # distinct parts in a range


def integers(df: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label and v (array of int, all of one length) of the rows that take part."""
    fine = F.expr(
        "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    )
    rows = df.where(fine).select(F.col("vec_id").cast("long"), "label", "embedding")
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(parts, -(-longest // parts) * parts)
    held = lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT))))
    filled = F.concat(F.transform("embedding", lambda x: held(x).cast("int")), F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding")))
    return rows.select("vec_id", "label", filled.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


# The trie


def nearest(sorted_parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance for rows in lexicographic order, no two alike.

    A stack of nodes: rows from `lo` to `hi` share their first `depth` components,
    and `spent` holds what these are away from every entry. Children with one leaf
    finish their remaining dimensions together.
    """
    n, width = sorted_parts.shape
    code, error = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    columns = np.ascontiguousarray(sorted_parts.T)
    entries = np.ascontiguousarray(book.T)  # dimension by dimension

    def leaves(rows: np.ndarray, spent: np.ndarray, depth: int) -> None:
        for d in range(depth, width):
            spent = spent + (columns[d][rows, None] - entries[d]) ** 2
        code[rows] = best = spent.argmin(axis=1)
        error[rows] = spent[np.arange(len(rows)), best]

    stack = [(0, n, 0, np.zeros(len(book), dtype=np.int64))] if n else []
    while stack:
        lo, hi, depth, spent = stack.pop()
        if depth == width:
            leaves(np.arange(lo, lo + 1), spent[None, :], depth)
            continue
        own = columns[depth][lo:hi]
        begin = lo + np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        end = np.append(begin[1:], hi)
        for at in range(0, len(begin), LEAVES_AT_ONCE):
            first, last = begin[at : at + LEAVES_AT_ONCE], end[at : at + LEAVES_AT_ONCE]
            child = spent + (columns[depth][first, None] - entries[depth]) ** 2
            single = last - first == 1
            if single.any():
                leaves(first[single], child[single], depth + 1)
            stack += [(a, b, depth + 1, s) for a, b, s in zip(first[~single], last[~single], child[~single])]
    return code, error


def encode(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of any rows: distinct ones go through one trie."""
    if not len(parts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    distinct, which = np.unique(parts, axis=0, return_inverse=True)
    code, error = nearest(distinct, book)
    return code[which.ravel()], error[which.ravel()]


# Training


def distinct_parts(vectors: DataFrame, parts: int = PARTS, range_parts: int = RANGE_PARTS) -> DataFrame:
    """pos, part and n: the different parts of each position with their numbers, in ranges in lexicographic order."""
    step = (F.size("v") / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("v", k * step + 1, step))
    counted = cut_lineage(vectors.select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")))
    ranges = max(1, -(-counted.count() // range_parts))
    ordered = counted.repartitionByRange(ranges, "pos", "part") if ranges > 1 else counted.repartition(parts, "pos")
    return cut_lineage(ordered.sortWithinPartitions("pos", "part"))


def _sums(batches, books):
    """Per position and entry the number of parts and their sums: added up over the task."""
    entries, width = books.shape[1:]
    total, count = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
    for b in small_batches(batches):
        pos, n = b.column(0).to_numpy(), b.column(2).to_numpy()
        part = matrix(b.column(1), width)
        for k in np.unique(pos):
            own = pos == k
            code, _ = encode(part[own], books[k])
            np.add.at(count[k], code, n[own])
            np.add.at(total[k], code, part[own] * n[own, None])
    k, e = np.nonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(k.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[k, e]), pa.array(list(total[k, e]), pa.list_(pa.int64()))],
        names=["pos", "entry", "n", "total"],
    )


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids, by position, entry and dimension."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    if not rows:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    first = np.array([r.v for r in rows], dtype=np.int64)
    return first.reshape(len(first), parts, -1).transpose(1, 0, 2)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks by position, entry and dimension, from rows as of `integers`."""
    books = first_books(vectors, parts, entries)
    if not books.size:
        return books
    distinct = distinct_parts(vectors, parts)
    width = books.shape[2]
    for _ in range(rounds):
        sums = distinct.mapInArrow(partial(_sums, books=books), "pos int, entry int, n long, total array<long>")
        added = [F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(width)]
        got = sums.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *added).collect()  # parts * entries rows at most
        books = books.copy()
        for r in got:
            books[r.pos, r.entry] = np.array(r[3:], dtype=np.int64) // r.n
    return books


def compress(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (array of int) and error of every row."""
    parts, _, width = books.shape

    def run(batches):
        for b in small_batches(batches, 8 << 20):
            rows = matrix(b.column(2), parts * width).reshape(-1, parts, width)
            found = [encode(np.ascontiguousarray(rows[:, k]), books[k]) for k in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(codes), pa.list_(pa.int32())), pa.array(sum(e for _, e in found))],
                names=["vec_id", "label", "codes", "error"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, codes array<int>, error long")


def decompress(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The rows of `compress` with `vector`: the middle of what each entry's integers stand for."""
    parts, _, width = books.shape
    middle = (books + 0.5) / scale

    def run(batches):
        for b in small_batches(batches, 4 << 20):
            at = matrix(b.column(0), parts)
            back = np.concatenate([middle[k][at[:, k]] for k in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], b.column(0), pa.array(list(back), pa.list_(pa.float64()))], names=names)

    rest = [c for c in codes.columns if c != "codes"]
    names = [*rest, "codes", "vector"]
    schema = ", ".join(f"`{c}` {codes.schema[c].dataType.simpleString()}" for c in rest)
    return codes.select("codes", *rest).mapInArrow(run, f"{schema}, codes array<int>, vector array<double>")


def digest(books: np.ndarray) -> str:
    """sha256 of all components by position, entry and dimension."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_trie_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's code of four bytes, its error, and the error of its label."""
    vectors = cut_lineage(integers(embeddings(spark, folder)))
    books = train(vectors)
    if not books.size:
        nothing = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], nothing)
    coded = cut_lineage(compress(vectors, books))
    # One row per label: stored, so that Spark knows its size.
    labels = cut_lineage(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))
    two = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", two.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    """Each round as tables of its own: distances, assignment, new entries."""
    near = """
a{n} AS (
  SELECT pos, part, (m % {e})::INTEGER AS entry, (m // {e})::BIGINT AS dist FROM (
    SELECT u.pos, u.part, min(list_sum(list_transform(range(1, len(u.part) + 1),
      lambda i: (u.part[i] - c.part[i]) * (u.part[i] - c.part[i])))::HUGEINT * {e} + c.entry) AS m
    FROM (SELECT DISTINCT pos, part FROM p) u JOIN c{n} c ON u.pos = c.pos GROUP BY u.pos, u.part))"""
    mean = """
m{n} AS (
  SELECT pos, entry, list((s - ((s % k) + k) % k) // k ORDER BY i)::BIGINT[] AS part FROM (
    SELECT pos, entry, i, sum(x) AS s, count(*) AS k FROM (
      SELECT p.pos, a.entry, unnest(range(1, len(p.part) + 1)) AS i, unnest(p.part) AS x
      FROM p JOIN a{b} a ON p.pos = a.pos AND p.part = a.part) GROUP BY pos, entry, i) GROUP BY pos, entry),
c{n} AS (
  SELECT c.pos, c.entry, coalesce(m.part, c.part) AS part FROM c{b} c LEFT JOIN m{n} m ON c.pos = m.pos AND c.entry = m.entry)"""
    steps = [near.format(n=0, e=entries)]
    for r in range(1, rounds + 1):
        steps += [mean.format(n=r, b=r - 1), near.format(n=r, e=entries)]
    return f"""
WITH f AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: greatest(least(floor(1024 * x::DOUBLE), {LIMIT}), -{LIMIT})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
w AS (SELECT greatest(1, ceil(max(len(v)) / {parts}.0))::BIGINT AS step FROM f),
v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
    SELECT vec_id, label, list_concat(v, list_transform(range(len(v), {parts} * step), lambda x: 0::BIGINT)) AS v FROM f, w)),
p AS (
  SELECT r, pos, list_slice(v, pos * step + 1, (pos + 1) * step) AS part
  FROM (SELECT r, v, step, unnest(range(0, {parts})) AS pos FROM v, w)),
c0 AS (SELECT pos, r - 1 AS entry, part FROM p WHERE r <= {entries}),{",".join(steps)},
coded AS (
  SELECT p.r, string_agg(printf('%02x', a.entry), '' ORDER BY p.pos) AS code, sum(a.dist)::BIGINT AS error
  FROM p JOIN a{rounds} a ON p.pos = a.pos AND p.part = a.part GROUP BY p.r),
sha AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, entry, i)) AS digest FROM (
    SELECT pos, entry, unnest(range(1, len(part) + 1)) AS i, unnest(part) AS x FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM v JOIN coded ON v.r = coded.r, sha"""


SQL = _sql()
