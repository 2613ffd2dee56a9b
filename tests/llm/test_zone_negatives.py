"""Op 12 against brute force and against its SQL."""

import math
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tidemark.llm import zone_negatives as zones

SCHEMA = "vec_id long, embedding array<float>, label int, row long, block int, folder string, rank int, score double, window int, v string"


def brute(rows, is_anchor, k=5, low=80, high=100, scale=256):
    """Plain loops. rows: vec_id, vector, label, all as the operator gets them."""
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    fine = [(i, v, x) for i, v, x in rows if x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    ints = [[max(-(2**20), min(2**20, math.floor(scale * f32(c)))) for c in v] for _, v, _ in fine]
    out = []
    for a, (anchor_id, _, label) in enumerate(fine):
        if not is_anchor(anchor_id):
            continue
        scored = [
            (-sum(x * y for x, y in zip(ints[a], ints[b])), i is None, i or 0, i, x)
            for b, (i, _, x) in enumerate(fine) if b != a
        ]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == label][:k]:
            bad = [s for s in scored if s[4] != label and -low * p[0] <= -100 * s[0] <= -high * p[0]][:k]
            out += [(anchor_id, p[3], n + 1, s[3], -p[0], -s[0]) for n, s in enumerate(bad)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = random.Random(4)
    middle = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(4)]
    rows = []
    for i in range(600):
        c = rng.randrange(4)
        rows.append((i, [m + rng.gauss(0, 0.6) for m in middle[c]], rng.choice([c, c, c, rng.randrange(12)])))
    rows += [(700, None, 1), (800, [], 1), (900, [None, 1.0], 1), (1000, [math.inf], 1), (1100, [math.nan, 1.0], 2), (1200, rows[0][1], None)]
    rows += [(100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2]), (None, rows[100][1], 11), (None, rows[100][1], 2)]
    rows += [(1300, [0.5, -0.5], 3), (1400, [3e7, -3e7, 0.0], 3), (1500, [-x for x in middle[0]], 77)]
    rows += [(2000 + i, rows[200][1], rows[200][2] if i % 2 else 9) for i in range(60)]
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], T._parse_datatype_string(SCHEMA))


def plain(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.collect()]


def moved(rows):
    return [(i, v, (x + 1) % 10 if x is not None and i is not None and i % 7 == 0 else x) for i, v, x in rows]


def test_op12(spark, odd_vectors, folder_of):
    some = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    for df in (odd_vectors, some, odd_vectors.limit(3), some.limit(0), odd_vectors.where("vec_id = 700")):
        folder = folder_of(embeddings=df)
        want = brute(moved(plain(df)), lambda i: i is not None and i % 100 == 0)
        got = zones.op12_zone_negatives(spark, folder)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect()), key=str) == want
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
        assert sorted(con.execute(zones.SQL).fetchall(), key=str) == want


def test_small_blocks_and_other_bounds(odd_vectors, monkeypatch):
    monkeypatch.setattr(zones, "ZONES_AT_ONCE", 5)
    monkeypatch.setattr(zones, "ANCHORS_AT_ONCE", 3)
    got = zones.mine(odd_vectors, F.col("vec_id") % 50 == 7, 3, 3, 50, 90, block_rows=4)
    want = brute(plain(odd_vectors), lambda i: i is not None and i % 50 == 7, 3, 50, 90)
    assert want and sorted(map(tuple, got.collect()), key=str) == want


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((1, 3), (2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        key = zones.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(1 << (bits * dims)))
        steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_bounds_hold_and_blocks_are_skipped(spark):
    rng = np.random.default_rng(2)
    # Two far groups: anchors of one need no block of the other.
    rows = [(i, [float(x) for x in rng.normal(0, 0.05, 8) + (1 if i % 2 else -1)], int(i % 4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    blocks = zones.store_blocks(zones.integers(df), 50)
    maps = zones.cut_lineage(zones.zone_maps(blocks))
    some = zones.cut_lineage(blocks.where("vec_id % 100 = 0").select("row", "label", "v", F.expr("array(1000L)").alias("least"), F.expr(f"array({zones.FAR}L)").alias("most")))
    for same in (True, False):
        chosen = {(r.row, r.block) for r in zones.choose(maps, some, same).collect()}
        pairs = blocks.select("block", F.col("row").alias("other"), F.col("label").alias("of"), F.col("v").alias("u")).crossJoin(some.select("row", "label", "v")).collect()
        need = {(r.row, r.block) for r in pairs if (r.of == r.label) == same and sum(a * b for a, b in zip(r.u, r.v)) >= 1000}
        every = {(r.row, r.block) for r in pairs}
        assert need <= chosen and len(chosen) < 0.6 * len(every)
