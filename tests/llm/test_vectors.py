"""Ops 6 and 10 against brute force."""

import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tidemark.llm import nn_descent, topk

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, is_query boolean, rank int, score double, query_id long"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(90)]
    rows += [(100, None), (120, []), (140, [None, 1.0]), (160, [math.inf, 0.0]), (180, [math.nan]), (200, [0.0] * 8)]
    rows += [(None, [1.0] * 8), (220, [0.5, -0.5]), (40, rows[40][1]), (41, rows[40][1]), (42, rows[40][1])]
    rows += [(300 + i, rows[40][1]) for i in range(30)]
    schema = T._parse_datatype_string(SCHEMA)
    return spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], schema)


def want_top(df, k=20, every=20):
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    rows = [(i, [math.floor(64 * f32(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (query_id, a) in enumerate(rows):
        if query_id is None or query_id % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for c, (i, b) in enumerate(rows) if c != q]
        out += [(query_id, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return sorted(out, key=str)


def test_op6(spark, odd_vectors, folder_of):
    some = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    for df in (odd_vectors, some, some.limit(0), odd_vectors.limit(5)):
        got = topk.op6_topk_bound(spark, folder_of(embeddings=df))
        assert sorted(map(tuple, got.collect()), key=str) == want_top(df)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_op6_sql(spark, odd_vectors, folder_of):
    folder = folder_of(embeddings=odd_vectors)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(topk.SQL).fetchall(), key=str) == want_top(odd_vectors)


@pytest.mark.parametrize("block_rows,dims", [(7, 1), (30, 3), (1000, 64)])
def test_blocks_of_any_size(odd_vectors, block_rows, dims):
    fine = topk.valid_rows(odd_vectors)
    got = topk.search(fine, fine.where(F.col("vec_id") % 20 == 0), 20, block_rows, dims)
    assert sorted(map(tuple, got.collect()), key=str) == want_top(odd_vectors)


def want_near(df, k=10, every=100):
    """Per query row its id and the (distance, vec_id) of the k nearest; a null vec_id comes last."""
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    rows = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in rows), default=0)
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in rows])
    out = []
    for q, (query_id, _) in enumerate(rows):
        if query_id is None or query_id % every:
            continue
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        near = sorted((s, i is None, i or 0) for c, (s, (i, _)) in enumerate(zip(d.tolist(), rows)) if c != q)[:k]
        out.append((query_id, [(s, None if none else i) for s, none, i in near]))
    return out


def near_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_op10_rows_that_repeat(spark, folder_of):
    schema = T._parse_datatype_string("vec_id long, embedding array<float>")
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 2.0]), (7, [1.0, 1.0]), (None, [1.0, 0.0]), (200, None)]
    df = spark.createDataFrame(rows, schema)
    got = nn_descent.op10_nn_descent(spark, folder_of(embeddings=df)).collect()
    flat = lambda q, near: [(q, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(near)]
    want = [r for q, near in want_near(df) for r in flat(q, near)]
    assert len(want) == 12
    assert sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got), key=str) == sorted(want, key=str)


def test_op10_small_tables(spark, odd_vectors, folder_of):
    for df in (odd_vectors, odd_vectors.limit(5), odd_vectors.limit(0)):
        got, want = near_of(nn_descent.op10_nn_descent(spark, folder_of(embeddings=df))), dict(want_near(df))
        assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in want.items()}
        assert all(np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-12) for q in want)


def test_op10_recall(spark):
    folder = "/root/testdata/sf0.1"
    got = near_of(nn_descent.op10_nn_descent(spark, folder))
    want = dict(want_near(spark.read.parquet(f"{folder}/embeddings.parquet")))
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    exact = {(q, i): s for q, r in want.items() for s, i in r}
    assert all(np.isclose(s, exact[q, i], atol=1e-12) for q, r in got.items() for s, i in r if (q, i) in exact)
