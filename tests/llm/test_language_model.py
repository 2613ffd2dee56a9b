"""Op 9 against plain counts and a plain forward recursion."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import chain, hmm


def slow_tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower:
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    return [*words, *[word] * bool(word), None]


def rest(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def want_base(rows):
    counts = Counter(t for d, text in rows if rest(d) not in (None, 2) for t in slow_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, text in rows:
        own = slow_tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        out.append((d, rest(d) == 2, len(own), sum(counts[t] > 0 for t in own), n, base))
    return sorted(out, key=str), counts


@pytest.mark.parametrize("classes,frequent", [(65_000, 65_000), (50, 200)])
def test_op9_base(spark, odd_docs, no_docs, some_docs, folder_of, classes, frequent):
    for docs in (odd_docs, no_docs, some_docs):
        got = hmm.op9_hmm_lm(spark, folder_of(documents=docs), states=3, classes=classes, frequent=frequent)
        rows = sorted(map(tuple, got.collect()), key=str)
        want, _ = want_base([(r.doc_id, r.text) for r in docs.collect()])
        assert [r[:5] for r in sorted(rows, key=lambda r: (str(r[0]), r[2], r[5]))] == [
            r[:5] for r in sorted(want, key=lambda r: (str(r[0]), r[2], r[5]))
        ]
        a, b = sorted(r[5] for r in rows), sorted(r[5] for r in want)
        assert np.allclose(a, b, rtol=1e-12)
        assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_likelihood_is_exact(spark, some_docs):
    """Scores equal a forward recursion over the whole vocabulary, whose words' shares sum to one."""
    held, learned = hmm.in_training()
    docs = hmm.whole_text(some_docs).select("doc_id", held.alias("held_out"), learned.alias("learned"), "text")
    counts = hmm.cut_lineage(hmm.word_counts(docs.where("learned")))
    vocabulary = hmm.vocabulary_of(counts, 300)
    coded = docs.mapInArrow(hmm.partial(hmm._code_rows, number=vocabulary.number), hmm.CODED)
    coded = hmm.cut_lineage(coded)
    model = hmm.train(coded, vocabulary, states=3, classes=40, passes=1, start_rows=50, start_passes=3)
    got = {r.doc_id: r.score for r in hmm.score(coded, counts, vocabulary, model, 40).collect()}
    count = {bytes(r.word): r.c for r in counts.collect()}
    shared = {w: c for w, c in count.items() if vocabulary.number.get(w, 10**9) > 40}
    whole = sum(c + 1 for c in shared.values()) + 1

    def emission(word):
        k = vocabulary.number.get(word, 10**9)
        return model.emit[k] if k <= 40 else model.emit[0] * (count.get(word, 0) + 1) / whole

    total = sum(emission(w) for w in count) + emission(b"\0 never seen")
    assert np.allclose(total, 1)
    assert np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    for r in some_docs.where("doc_id < 40").collect():
        state, log = model.start, 0.0
        for t, word in enumerate(hmm.tokens_of(r.text)):
            state = (state if t == 0 else state @ model.move) * emission(word)
            log += math.log10(state.sum())
            state = state / state.sum()
        assert math.isclose(got[r.doc_id], log, rel_tol=1e-9)


def test_states_help_on_held_out_texts(spark):
    rows = hmm.op9_hmm_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    sequences = [rng.integers(0, 6, rng.integers(1, 40)) + 6 * (k % 2) for k in range(60)]
    mass = np.full(12, 1 / 12)
    model, last = hmm.first_model(mass, 2), -math.inf
    for _ in range(15):
        counts = hmm.expected(model, sequences)
        assert math.isclose(counts[2].sum(), sum(map(len, sequences)))
        model = hmm.refit(counts, mass)
        lengths = np.array([len(s) for s in sequences])
        now = 0.0
        for run in hmm.chain.by_length(lengths):
            steps = hmm.chain.Steps(lengths[run])
            seq = np.empty(int(lengths[run].sum()), dtype=int)
            seq[steps.place] = np.concatenate([sequences[i] for i in run])
            now += np.log(hmm.chain.forward(steps, model.start, model.move, model.emit[seq], keep=False)[1]).sum()
        assert now > last - 1.0
        last = now


def test_every_pass_reads_all_training_documents(spark, monkeypatch):
    made = [(i, f"word{i % 7} other") for i in range(4000)]
    held, learned = hmm.in_training()
    docs = spark.createDataFrame(made, "doc_id long, text string").select("doc_id", held.alias("held_out"), learned.alias("learned"), "text")
    vocabulary = hmm.vocabulary_of(hmm.word_counts(docs.where("learned")), 40)
    coded = docs.mapInArrow(hmm.partial(hmm._code_rows, number=vocabulary.number), hmm.CODED)
    seen = []
    monkeypatch.setattr(hmm, "one_pass", lambda rows, model, mass, classes: seen.append(rows.count()) or model)
    hmm.train(coded, vocabulary, states=2, classes=40)
    assert seen and set(seen) == {docs.where("learned").count()}


def test_expected_counts_hold_few_arrays_of_a_run():
    import tracemalloc

    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 50, n) for n in rng.integers(1, 400, 1200)]
    model = hmm.first_model(np.full(50, 1 / 50), 8)
    rows = sum(map(len, sequences))
    assert rows > 10 * chain.SLICE
    tracemalloc.start()
    start, move, words = hmm.expected(model, sequences)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.5 * rows * 8 * 8  # emissions, forward, backward, and what is small beside them
    assert math.isclose(move.sum(), rows - len(sequences)) and math.isclose(start.sum(), len(sequences))
    assert np.allclose(words.sum(axis=1), np.bincount(np.concatenate(sequences), minlength=50))


def test_steps_take_no_more_rows_of_their_own():
    """Backward rows and moves come from the emissions' own place, and are those of the plain recursion."""
    rng = np.random.default_rng(5)
    steps = chain.Steps(np.array([40, 40, 9, 1]))
    start, move, emit = rng.random(3), rng.random((3, 3)), rng.random((90, 3))
    alpha, scale = chain.forward(steps, start, move, emit)
    beta = chain.backward(steps, move, emit, scale)
    want = chain.transitions(steps, alpha, move, emit, scale, beta)
    own = emit.copy()
    assert np.allclose(chain.backward_in_place(steps, move, own, scale), beta)
    first = int(steps.begin[1])
    assert np.allclose(own[first:], (emit * beta / scale[:, None])[first:])
    assert np.allclose(chain.transitions_into(steps, alpha, move, own), want)
    assert np.allclose((alpha * beta).sum(axis=1), 1)
