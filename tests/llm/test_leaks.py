"""Op 13 against brute force and against its SQL."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    cut = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for s in range(len(w) - n + 1) if w else ():
            cut.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    lengths, out = {len(c) for c in cut}, []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                own = cut.get(tuple(w[s : s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    names |= own
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_items(spark):
    prose = "the quick brown fox, jumps over the lazy dog's 12 bones. "
    rows = [
        (1, prose), (2, None), (3, ""), (4, "..."), (5, "the cat sat on the mat"), (5, "another text"), (None, "no id at all"),
        (6, "你好 世界"), (7, "Over THE lazy; dog s 12 bones the quick brown fox jumps"), (8, "a b c d e f g h i j k l m"),
        (9, "z"), (10, "one two three four five six seven eight nine ten eleven"), (11, "the " * 12),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, run string, start int")


@pytest.fixture(scope="module")
def more_docs(odd_docs, spark):
    texts = [
        (20, "A b c d e f g h i j. k"), (21, "b c d e f g h i j k l m n"), (22, "c d e f g h i j k"), (23, "b c d e f X g h i j k l m"),
        (24, "the the the the the the the the the the the"), (24, "the the the the the the the the the the the"),
        (25, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten eleven"),
        (25, "one two three four five. Six seven eight nine ten eleven"), (None, "a b c d e f g h i j"), (26, "z z top"),
    ]
    return odd_docs.unionByName(spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True)


def pairs(df, key):
    return [tuple(r) for r in df.select(key, "text").collect()]


def same(got):
    return sorted(map(tuple, got.collect()), key=str)


def test_op13(spark, more_docs, odd_items, some_docs, folder_of):
    some = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for docs, items in ((more_docs, odd_items), (some_docs, some), (more_docs.limit(0), some), (some_docs, some.limit(0))):
        folder = folder_of(documents=docs, benchmark=items)
        want = brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
        got = leaks.op13_leak_prefix(spark, folder)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert same(got) == want
        con = duckdb.connect()
        for name in ("documents", "benchmark"):
            con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
        assert sorted(con.execute(leaks.SQL).fetchall(), key=str) == want


@pytest.mark.parametrize("window,shingle", [(10, 3), (4, 4), (7, 5), (3, 2), (13, 4)])
def test_any_window(more_docs, odd_items, window, shingle):
    got = leaks.decontaminate(more_docs, odd_items, window, shingle, broadcast_chars=0)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.expr("n_hit > 0"))
    assert same(got) == brute(pairs(more_docs, "doc_id"), pairs(odd_items, "item_id"), window)


def test_common_wording_brings_no_candidates(spark):
    common = "all rights reserved by the owner of this site and its many friends"
    docs = [(i, f"{common} doc{i} " * 3) for i in range(200)] + [(999, f"x {common} rare1 rare2 rare3 rare4 y")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(k, f"{common} rare{k} rare2 rare3") for k in range(3)], "item_id long, text string")
    got = {r.doc_id: r for r in leaks.decontaminate(docs, items).collect()}
    assert got[999]["items"] == ["0", "1", "2"] and got[999].n_hit == 16 and got[0].n_hit == 39
