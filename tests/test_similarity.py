"""Near-text joins, components and vector clusters against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import rows
from tidemark.operators import components as comp, similarity as sim, vector_clusters as vc


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components(spark, edges):
    edges = [e for e in edges if e[0] != e[1]] or [(1, 2)]
    nodes = {n for e in edges for n in e}
    df = spark.createDataFrame([(0, *e) for e in edges], "g int, u int, v int")
    assert rows(comp.components(df), "node") == [(0, n, r) for n, r in sorted(roots(nodes, edges).items())]


def test_long_chain_settles(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame([(0, a, b) for a, b in zip(order, order[1:])], "g int, u int, v int")
    assert {r[2] for r in rows(comp.components(df))} == {0}


WORDS = [f"w{i}" for i in range(40)]


def texts(seed, n=60):
    """Random texts, near copies, exact copies, an empty one, and a large group of near copies."""
    rng = random.Random(seed)
    made = [" ".join(rng.choices(WORDS, k=rng.randint(1, 12))) for _ in range(n)]
    base = " ".join(rng.choices(WORDS, k=15))
    made += [base + f" {rng.choice(WORDS)}" for _ in range(n // 2)] + [base] * 5 + ["", " . "]
    rng.shuffle(made)
    return [(i, "b1" if i % 4 else "b2", t) for i, t in enumerate(made)]


def vectors(docs):
    out = {}
    for block in {b for _, b, _ in docs}:
        bags = {i: Counter(t.split()) for i, b, t in docs if b == block and t.strip(" .")}
        df = Counter(w for bag in bags.values() for w in bag)
        for i, bag in bags.items():
            raw = {w: c * (math.log((1 + len(bags)) / (1 + df[w])) + 1) for w, c in bag.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            out[i] = (block, {w: x / norm for w, x in raw.items()})
    return out


def distance(a, b):
    return 1 - sum(x * b.get(w, 0.0) for w, x in a.items())


def near(docs, eps):
    v = vectors(docs)
    return {
        (i, j): distance(v[i][1], v[j][1])
        for i in v for j in v if i < j and v[i][0] == v[j][0] and distance(v[i][1], v[j][1]) <= eps + 1e-9
    }


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block_rows", [3, 2000])
def test_clusters_match_brute_force(spark, monkeypatch, seed, block_rows):
    monkeypatch.setattr(sim, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(sim.heads, "__defaults__", (block_rows,))
    docs = texts(seed)
    df = spark.createDataFrame(docs, "doc_id int, company string, title string")
    grid = [0.05, 0.4]
    out = sim.clusters(df, "title", "company", grid, stop=[])
    got = {(r["g"], r["doc_id"]): r["cluster"] for r in out.collect()}
    for eps in grid:
        pairs = near(docs, eps)
        linked = {n for p in pairs for n in p}
        root = roots([i for i, _, _ in docs], pairs)
        for i, _, _ in docs:
            assert got[(eps, i)] == (root[i] if i in linked else -1), (eps, i)


@pytest.mark.parametrize("eps", [0.02, 0.3, 0.6])
def test_pairs_match_brute_force(spark, eps):
    docs = texts(5, 40)
    df = spark.createDataFrame(docs, "doc_id int, company string, title string")
    post, same = sim.distinct_postings(df, "title", "company", stop=[])
    reps = {r["rep"] for r in same.collect()}
    got = {(r["i"], r["j"]): r["distance"] for r in sim.near_pairs(post, eps).collect()}
    want = {p: d for p, d in near(docs, eps).items() if set(p) <= reps}
    assert set(got) == set(want)
    assert all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in got)


@pytest.mark.parametrize("bound", [0.2, 0.5, 0.8])
def test_jaccard_matches_brute_force(spark, bound):
    docs = texts(6, 40)
    df = spark.createDataFrame(docs, "doc_id int, company string, title string")
    sets = {}
    for i, b, t in docs:
        if t.strip(" ."):
            sets.setdefault((b, frozenset(t.split())), i)
    want = {}
    for (b, s), i in sets.items():
        for (c, u), j in sets.items():
            d = 1 - len(s & u) / len(s | u)
            if b == c and i < j and d <= bound + 1e-9:
                want[(i, j)] = d
    got = {(r["i"], r["j"]): r["distance"] for r in sim.jaccard_pairs(df, "title", "company", bound, stop=[]).collect()}
    assert set(got) == set(want) and all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in got)


@pytest.mark.parametrize("eps,part", [(0.05, 4), (0.3, 1000), (0.6, 7)])
def test_vector_clusters_match_brute_force(spark, eps, part):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    x = np.vstack([centres[i % 6] + rng.normal(scale=0.3, size=8) for i in range(90)] + [np.zeros(8)] * 2)
    x = np.vstack([x, x[:3]]).astype(np.float32)
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id int, b int, v array<float>")
    got = {r["id"]: r["cluster"] for r in vc.vector_clusters(df, "id", "v", "b", eps, part).collect()}
    y = x.astype(np.float64)
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)
    edges = [(i, j) for i in range(len(y)) for j in range(i + 1, len(y)) if i % 2 == j % 2 and 1 - y[i] @ y[j] <= eps]
    linked, root = {n for e in edges for n in e}, roots(range(len(y)), edges)
    assert got == {i: (root[i] if i in linked else -1) for i in range(len(y))}


def test_first_story(spark):
    docs = spark.createDataFrame([(1, 3), (2, 1), (3, 1), (4, 9)], "doc_id int, published int")
    labelled = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", -1), (4, "a", -1)], "doc_id int, block string, cluster int")
    out = sim.first_stories(labelled, docs)
    assert rows(out.select("doc_id", "first_story"), "doc_id") == [(1, 0), (2, 1), (3, 1), (4, 0)]


def test_words_are_counted_without_a_shuffle_of_words(spark):
    from tidemark.operators import text_vectors as tv

    schema = "block string, doc_id long, words array<string>, _c long"
    rows = [("a", 1, ["b", "a", "b"], 1), ("a", 2, ["c"], 1), ("b", 3, ["é", "b", "é", "é"], 2)]
    lists = spark.createDataFrame(rows, schema)
    none = lists.select("block", "doc_id", "_c").where("false")
    got = tv._token_counts(lists, none)
    want = {("a", 1, 1, "a", 1), ("a", 1, 1, "b", 2), ("a", 2, 1, "c", 1), ("b", 3, 2, "b", 1), ("b", 3, 2, "é", 3)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 5
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_in_several_rows_are_one_text(spark):
    from tidemark.operators import text_vectors as tv

    rows = [("a", 1, ["x", "y"]), ("a", 1, ["x"]), ("a", None, ["x"]), ("a", None, ["x", "z"]), ("a", 2, ["y"]), ("b", 1, ["x"])]
    lists = spark.createDataFrame(rows, "block string, doc_id long, words array<string>")
    got = {(r["block"], r["doc_id"], r["token"]): (r["tf"], r["df"]) for r in tv.tf_idf(lists).collect()}
    assert got == {
        ("a", 1, "x"): (2, 2), ("a", 1, "y"): (1, 2), ("a", None, "x"): (2, 2), ("a", None, "z"): (1, 1), ("a", 2, "y"): (1, 2),
        ("b", 1, "x"): (1, 1),
    }
