"""Op 1: held-out accuracy, and forward-backward against all label paths."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import chain, crf


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(2)
    lengths = [4, 1, 3, 0, 4, 2]
    emit_of = rng.uniform(0.1, 1, (9, 3))
    model = crf.Model(["a", "b", "c"], {}, np.zeros((1, 3)), rng.normal(size=(3, 3)))
    sequences = [rng.integers(0, 9, n) for n in lengths]
    move = crf.factor(model.moves)
    for run, steps, emit, alpha, beta, scale, _ in crf.chances(model, emit_of, sequences):
        gamma = (alpha * beta)[steps.place]
        moves = chain.transitions(steps, alpha, move, emit, scale, beta)
        want_moves, at = np.zeros((3, 3)), 0
        for i in run:
            s = sequences[i]
            weight = {}
            for path in itertools.product(range(3), repeat=len(s)):
                w = np.prod([emit_of[x, y] for x, y in zip(s, path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
                weight[path] = w
            z = sum(weight.values())
            for t in range(len(s)):
                want = [sum(w for p, w in weight.items() if p[t] == y) / z for y in range(3)]
                assert np.allclose(gamma[at + t], want)
            for p, w in weight.items():
                for a, b in zip(p, p[1:]):
                    want_moves[a, b] += w / z
            at += len(s)
        assert np.allclose(moves, want_moves)


def test_op1_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = crf.op1_language_crf(spark, folder)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_op1_odd_rows(spark, odd_docs, no_docs, some_docs, folder_of):
    docs = odd_docs.unionByName(some_docs.where("doc_id >= 100"), allowMissingColumns=True)
    got = crf.op1_language_crf(spark, folder_of(documents=docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {2, 3, 4, None} or und == {2, 3, 4}
    assert sum(r.lang_pred == "und" for r in got) == 4
    assert all(r.held_out is not None and (r.lang_pred != "und" or r.score == 0) for r in got)
    assert crf.op1_language_crf(spark, folder_of(documents=no_docs)).collect() == []
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in crf.op1_language_crf(spark, folder_of(documents=unlabelled)).collect()} == {"und"}


def test_code_switched_words(spark, some_docs):
    model = crf.learn(some_docs, rows_per_label=60)
    one = {r.lang: r.text for r in some_docs.where("lang in ('en', 'de') and n_chars > 800").collect()}
    mixed = " ".join(one["en"].split()[:40]) + " " + " ".join(one["de"].split()[:40])
    rows = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    labels = [w.label for w in crf.label_words(rows, model).first().words]
    half = len(labels) // 2
    assert labels[: half - 5].count("en") > 0.8 * (half - 5) and labels[half + 5 :].count("de") > 0.8 * (half - 5)


def test_long_runs_count_whole():
    from tidemark.llm.crf import has_letter, words_of

    run = "ab" * 250 + "жщ" * 250
    words = words_of(run)
    assert "".join(words) == run and max(map(len, words)) == 32 and len(words) == 32
    assert words_of("我们都 go สวัสดี") == [*"我们都", "go", *[c for c in "สวัสดี" if has_letter(c)]]


def test_runs_without_spaces_are_told_apart(spark):
    rng = random.Random(4)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(600))
    latin, other = "abcdefghijklm", "nopqrstuvwxyz"
    rows = [(i, " ".join(make(s)[:7] for _ in range(20)), lang) for i in range(60) for s, lang in ((latin, "x"), (other, "y"))]
    model = crf.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # The ends are of one kind, what lies between of the other.
    tests = [(1, latin[:9] * 2 + make(other) + latin[:9] * 2), (2, other[:9] * 2 + make(latin) + other[:9] * 2)]
    got = crf.predict(spark.createDataFrame(tests, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["y", "x"]
