"""Op 4 against a plain version and its SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import rendezvous


def draw(key, j):
    return hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13]


def want(rows):
    out, slots = [], defaultdict(list)
    for d, t in rows:
        data = (t or "").encode()
        key = "null" if d is None else str(d)
        s, g = (max(range(n), key=lambda j: draw(key, j)) for n in (8, 9))
        slots[s].append(((d is not None, d or 0), len(data) + 1, zlib.crc32(data), d, g))
    for s, own in slots.items():
        out += [(d, size, crc, "key", s, i, g) for i, (_, size, crc, d, g) in enumerate(sorted(own, key=lambda x: x[:3]))]
    return sorted(out, key=str)


def test_op4(spark, odd_docs, no_docs, some_docs, folder_of):
    for docs in (odd_docs, some_docs, no_docs):
        got = rendezvous.op4_rendezvous(spark, folder_of(documents=docs))
        assert sorted(map(tuple, got.collect()), key=str) == want([(r.doc_id, r.text) for r in docs.collect()])
        assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_sql(spark, odd_docs, folder_of):
    folder = folder_of(documents=odd_docs)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    got = rendezvous.op4_rendezvous(spark, folder)
    found = con.execute(rendezvous.SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(found, key=str)


def test_records_move_only_into_the_new_shard(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    placed = rendezvous.assign(rows, [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 4.0]).collect()
    counts = [sum(r.shard == j for r in placed) / len(placed) for j in range(3)]
    assert all(abs(c - w) < 0.02 for c, w in zip(counts, (0.25, 0.5, 0.25)))
    assert all(r.grown_shard in (r.shard, 3) for r in placed)
    assert abs(sum(r.grown_shard == 3 for r in placed) / len(placed) - 0.5) < 0.02
    for j in range(3):
        assert sorted(r.slot for r in placed if r.shard == j) == list(range(sum(r.shard == j for r in placed)))
