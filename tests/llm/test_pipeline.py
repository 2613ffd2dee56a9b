"""The pipeline's stages on their own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm.simhash import fingerprint
from tidemark.session import cut_lineage


def edited(rng, text, share):
    words = text.split(" ")
    for k in rng.sample(range(len(words)), max(1, int(len(words) * share))):
        words[k] = "changed" + str(rng.randrange(10**6))
    return " ".join(words)


def test_near_copies_keeps_one_of_each_group(spark, some_docs):
    rng = random.Random(1)
    docs = [tuple(r) for r in some_docs.collect()]
    base = [r for r in docs if len(r[1].split()) > 120][:40]
    more = []
    for k, r in enumerate(base):
        more += [(10_000 + 10 * k + n, edited(rng, r[1], share), *r[2:]) for n, share in enumerate((0.002, 0.004, 0.01))]
        more += [(20_000 + k, r[1], *r[2:]), (r[0], r[1], *r[2:]), (None, r[1], *r[2:])]
    more += [(30_000, None, "en", "s", 0), (30_001, None, "en", "s", 0), (30_002, "", "en", "s", 0), (30_003, " ", "en", "s", 0)]
    more += [(None, "only here without an id", "en", "s", 0), (None, "only here without an id", "en", "s", 0)]
    rows = docs + more
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, some_docs.schema), "").collect()
    # All pairs of fingerprints, by plain loops.
    prints = [fingerprint(r[1] or "") & (2**64 - 1) for r in rows]
    names = sorted(set(prints))
    root = {p: p for p in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(names):
        for b in names[:n]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = {}
    for r, p in zip(rows, prints):
        groups.setdefault(find(p), []).append(r)
    least = lambda r: (r[0] is None, r[0] or 0)
    assert len(kept) == len(groups) < len(rows) - 80
    assert sorted(least(r) for r in kept) == sorted(min(map(least, g)) for g in groups.values())
    assert all(tuple(r) in set(rows) for r in kept)


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs, some_docs):
    docs = odd_docs.unionByName(some_docs.where("doc_id >= 100"), allowMissingColumns=True)
    for table in (docs, no_docs):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = cut_lineage(stage(spark, now, ""))
            assert now.columns == table.columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}
    assert pieces == []


def test_language_keeps_clean_documents(spark, some_docs, odd_docs):
    kept = corpus_pipeline.language(spark, some_docs, "")
    assert kept.count() >= 0.98 * some_docs.count()
    both = odd_docs.unionByName(some_docs.where("doc_id >= 100"), allowMissingColumns=True)
    left = {r.text for r in corpus_pipeline.language(spark, both, "").collect()}
    assert not left & {None, "", " "}
    nothing = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, nothing, "").where("text is null or text = ''").isEmpty()


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert pieces and all(r.length <= 2048 for r in pieces)
    texts = [t for _, t in corpus_pipeline.STAGES]
    assert len(texts) == 4 and corpus_pipeline.ORACLE_SQL is None
