"""Op 3 against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def slow_print(text, size=3):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(grams)) if grams else 0


def slow_groups(prints, budget=2):
    """prints: distinct numbers -> the least number of each one's group."""
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def want(rows, size=3):
    prints = [(d, slow_print(t, size)) for d, t in rows]
    group = slow_groups({p for _, p in prints})
    least = defaultdict(list)
    for d, p in prints:
        least[group[p]].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in least.items()}
    return sorted(((d, f"{p:016x}", least[group[p]]) for d, p in prints), key=str)


def test_op3(spark, odd_docs, no_docs, some_docs, folder_of):
    near = some_docs.where("doc_id < 20").withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.concat("text", F.lit(" end."))})
    for docs in (odd_docs, no_docs, some_docs.unionByName(near)):
        got = simhash.op3_simhash_trie(spark, folder_of(documents=docs))
        assert sorted(map(tuple, got.collect()), key=str) == want([(r.doc_id, r.text) for r in docs.collect()])
        assert got.columns == ["doc_id", "fingerprint", "component_id"]


@pytest.mark.parametrize("depth", [0, 3, 7])
@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_walk_finds_every_pair(depth, budget):
    rng, values = random.Random(depth), set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(12):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    order = rng.sample(range(64), 64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(values, "u8").view("i8"))], names=["print"])
    import pandas as pd

    rows = pd.concat([b.to_pandas() for b in simhash._place_rows([batch], order, depth, budget)])
    edges = pd.concat([simhash._node_links(g, order, depth, budget) for _, g in rows.groupby("node")])
    at = {v: i for i, v in enumerate(values)}
    place = lambda c: np.array([at[int(x) & (2**64 - 1)] for x in c], dtype=int)
    got = simhash.connecting(place(edges.u), place(edges.v), len(values))
    group = slow_groups(values, budget)
    assert [values[g] for g in got] == [group[v] for v in values]


def test_many_nodes_give_the_same_groups(spark, some_docs):
    prints = simhash.fingerprints(some_docs)
    reps = prints.select("print").distinct()
    few = simhash.groups(prints).collect()
    flipped = reps.unionByName(reps.select(F.col("print").bitwiseXOR(F.lit(5)).alias("print"))).distinct()
    a = simhash.components(simhash.links(flipped).select(F.lit(0).alias("g"), "u", "v"))
    b = simhash.components(simhash.links(flipped, node_rows=8).select(F.lit(0).alias("g"), "u", "v"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert len(few) == some_docs.count()
