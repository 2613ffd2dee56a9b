"""Op 11 against brute force and against its SQL."""

import hashlib
import math
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from tidemark.llm import trie_codes

SCHEMA = "vec_id long, embedding array<float>, label int, pos int, part string, entry int, n long, v string, codes int, error long"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain loops over Python integers. rows: vec_id, vector, label."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    step = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    ints = [[max(-(2**27), min(2**27, math.floor(scale * f32(x)))) for x in v] + [0] * (parts * step - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, ints[r]))
    cut = [[tuple(v[k * step : (k + 1) * step]) for k in range(parts)] for v in ints]
    books = [[cut[r][k] for r in order[:entries]] for k in range(parts)]

    def assign(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            members = [[] for _ in books[k]]
            for c in cut:
                members[assign(c[k], books[k])[1]].append(c[k])
            books[k] = [tuple(sum(x) // len(m) for x in zip(*m)) if m else e for m, e in zip(members, books[k])]
    found = [[assign(c[k], books[k]) for k in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, x), e in zip(kept, error):
        labels[x] = labels.get(x, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (i, "".join(f"{n:02x}" for _, n in f), e, labels[x], digest) for (i, _, x), f, e in zip(kept, found, error)
    ]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], rng.choice([None, 0, 1, 2])) for i in range(1, 330)]
    rows += [(900, None, 1), (901, [], 1), (902, [None, 1.0], 1), (903, [math.inf], 1), (904, [math.nan, 1.0], 2), (None, [0.5] * 6, None)]
    rows += [(5, [0.25] * 6, 3), (5, [0.25] * 6, 3), (5, [0.1] * 5, 4), (905, [1e6, -1e6, 0.0], 5), (-4, [0.0] * 6, 2)]
    rows += [(2000 + i, [0.125] * 6, 1) for i in range(150)]
    schema = T._parse_datatype_string(SCHEMA)
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], schema)


def rows_of(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.collect()]


def test_op11(spark, odd_vectors, folder_of):
    some = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(400)
    for df in (odd_vectors, some, odd_vectors.limit(3), some.limit(0), odd_vectors.where("vec_id = 900")):
        folder = folder_of(embeddings=df)
        want = sorted(brute(rows_of(df)), key=str)
        got = trie_codes.op11_trie_codes(spark, folder)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
        assert sorted(con.execute(trie_codes.SQL).fetchall(), key=str) == want


def test_trie_walk_is_exact():
    rng = np.random.default_rng(5)
    for spread in (2, 5, 400):
        for n, width, entries in ((1, 1, 1), (300, 3, 7), (500, 16, 40), (5000, 2, 3)):
            parts = rng.integers(-spread, spread, (n, width))
            book = rng.integers(-spread, spread, (entries, width))
            dist = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
            code, error = trie_codes.encode(parts, book)
            assert (code == dist.argmin(axis=1)).all() and (error == dist.min(axis=1)).all()


def test_ranges_change_nothing(spark, odd_vectors, monkeypatch):
    vectors = trie_codes.cut_lineage(trie_codes.integers(odd_vectors))
    want = trie_codes.train(vectors)
    monkeypatch.setattr(trie_codes, "distinct_parts", lambda v, parts, f=trie_codes.distinct_parts: f(v, parts, range_parts=60))
    assert (trie_codes.train(vectors) == want).all()


def test_round_trip_is_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = trie_codes.cut_lineage(trie_codes.integers(df))
    books = trie_codes.train(vectors)
    back = trie_codes.decompress(trie_codes.compress(vectors, books), books)
    pairs = back.join(df.select("vec_id", "embedding"), "vec_id").collect()
    gap = [sum((a - b) ** 2 for a, b in zip(r.vector, r.embedding)) for r in pairs]
    assert len(pairs) == df.count() and np.mean(gap) < 0.5  # of vectors of length 1
    assert all(abs(g * 1024**2 - r.error) <= 3 * 1024 for g, r in zip(gap, pairs))
