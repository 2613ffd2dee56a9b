"""Scoring whole texts by a hidden Markov language model.

Words are counted over all training documents. The `classes` most frequent words
(the end of a document is one of them) are classes of their own; all others share
one class, in which a word has the share (count + 1) of the class, one further
share being that of words never seen. Baum-Welch finds the latent states, from
states that like to stay, in `passes` passes that each read all training documents.
In every pass expected counts are added up across partitions; no task holds more
than its own. A scaled forward recursion gives the
exact log-likelihood of a text.

Frequent words are known to every task (their number is a parameter); rare ones
meet their counts in a join, in which no word is frequent. Words are compared as
bytes, A-Z in lower case.

Null text counts as empty: its only token is the end. Rows that repeat each give
a row; a null doc_id is neither held out nor learned from. Without any training
document every word is unknown. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm import chain
from tidemark.llm.rows import documents, small_batches, task_number, whole_text
from tidemark.session import cut_lineage

STATES, CLASSES, FREQUENT, PASSES, START_ROWS, START_PASSES = 8, 65_000, 65_000, 6, 1500, 0
START_SHARE = 1 / 32
FLUSH_WORDS = 400_000
RUN_ROWS = 1 << 18  # rows of a run: a task holds three arrays of them
BLOCK = 1024  # classes whose expected counts travel together
END = b" "  # no word holds a space
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LN10 = math.log(10)


def tokens_of(text: str) -> list[bytes]:
    """Words between ASCII white space, and one end."""
    return [*text.encode().translate(_LOWER).split(), END]


def in_training(folds: int = 7, held: int = 2) -> tuple[Column, Column]:
    """(held out, learned from): by the checksum of doc_id as text."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(rest == held, F.lit(False)), F.coalesce(rest != held, F.lit(False))


# Counts


def _count_rows(batches):
    seen: Counter[bytes] = Counter()

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    for b in small_batches(batches):
        for text in b.column(0).to_pylist():
            seen.update(tokens_of(text))
        if len(seen) > FLUSH_WORDS:
            yield out()
            seen.clear()
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes) and c, its count over all rows of column `text`."""
    counted = texts.select("text").mapInArrow(_count_rows, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words with their numbers from 1, most frequent first, and what all counts add up to."""

    number: dict[bytes, int]
    counts: np.ndarray  # by number; 0 is for the rest
    tokens: int
    words: int

    @property
    def log_base(self) -> float:
        return math.log10(self.tokens + self.words + 1)


def vocabulary_of(counts: DataFrame, size: int) -> Vocabulary:
    """The most frequent words, at most `size`: all words of a count, or none, are among them.

    The least count that is let in comes from how many words have each count
    (there are few different counts), so that no more rows than that come back.
    """
    total = counts.agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    alike = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = alike.withColumn("so_far", so_far).where(F.col("so_far") <= size).agg(F.min("c")).first()[0]
    found = counts.where(F.col("c") >= F.lit(least)).collect() if least is not None else []
    top = sorted(found, key=lambda r: (-r["c"], bytes(r["word"])))
    return Vocabulary(
        {bytes(r["word"]): k + 1 for k, r in enumerate(top)},
        np.array([0, *(r["c"] for r in top)], dtype=np.int64),
        total["tokens"] or 0,
        total["words"],
    )


# Texts as numbers

CODED = "row long, doc_id long, held_out boolean, learned boolean, n_tokens long, ids binary, rare array<binary>"


def _code_rows(batches, number):
    """Numbers of frequent words (0 for others) and the other words themselves."""
    row = task_number() << 40
    get = number.get
    for b in small_batches(batches):
        ids, rare, n = [], [], []
        for text in b.column(3).to_pylist():
            words = tokens_of(text)
            own = [get(w, 0) for w in words]
            ids.append(np.array(own, dtype="<u2").tobytes())
            rare.append([w for w, i in zip(words, own) if not i] if 0 in own else [])
            n.append(len(words))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(row, row + b.num_rows), pa.int64()), b.column(0), b.column(1), b.column(2),
                pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary())),
            ],
            names=[c.split()[0] for c in CODED.split(", ")],
        )
        row += b.num_rows


# The model


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    @property
    def states(self) -> int:
        return len(self.start)


def class_of(ids: np.ndarray, classes: int) -> np.ndarray:
    """Classes of numbered words: words beyond the most frequent `classes` are class 0."""
    return np.where(ids <= classes, ids, 0)


def first_model(mass: np.ndarray, states: int, seed: int = 7) -> Model:
    """States that like to stay, with the words' shares a little disturbed."""
    rng = np.random.default_rng(seed)
    emit = mass[:, None] * rng.uniform(0.7, 1.3, (len(mass), states))
    move = np.full((states, states), 0.02 / max(1, states - 1)) + np.eye(states) * 0.98
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and words under the model."""
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    start, move, words = np.zeros(model.states), np.zeros_like(model.move), np.zeros_like(model.emit)
    for run in chain.by_length(lengths, RUN_ROWS):
        steps = chain.Steps(lengths[run])
        seq = np.empty(int(lengths[run].sum()), dtype=np.int64)
        seq[steps.place] = np.concatenate([sequences[i] for i in run])
        emit = np.take(model.emit, seq, axis=0)
        alpha, scale = chain.forward(steps, model.start, model.move, emit)
        beta = chain.backward_in_place(steps, model.move, emit, scale)
        move += chain.transitions_into(steps, alpha, model.move, emit)
        alpha *= beta
        start += alpha[: steps.active[0]].sum(axis=0)
        for k in range(model.states):
            words[:, k] += np.bincount(seq, alpha[:, k], len(words))
        del emit, alpha, beta, scale  # the next run's come in their place
    return start, move, words


def refit(counts: tuple[np.ndarray, np.ndarray, np.ndarray], mass: np.ndarray) -> Model:
    """The next model; every state keeps a little of the words' overall shares."""
    start, move, words = counts
    start, move = start + 1 / len(start), move + 1 / len(start)
    words = words + 20 * mass[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), words / words.sum(axis=0))


def _sequences(column, classes: int) -> list[np.ndarray]:
    return [class_of(np.frombuffer(x, "<u2").astype(np.int64), classes) for x in column.to_pylist()]


def _expected_rows(batches, model, classes):
    """Expected counts of a partition's rows, in blocks of classes; block -1 has starts and moves."""
    total = None
    for b in small_batches(batches, 4 << 20):
        got = expected(model, _sequences(b.column(0), classes))
        total = got if total is None else tuple(x + y for x, y in zip(total, got))
    if total is not None:
        start, move, words = total
        blocks = [np.vstack([start, move]), *(words[i : i + BLOCK] for i in range(0, len(words), BLOCK))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(blocks) - 1), pa.int32()), pa.array([x.astype("<f8").tobytes() for x in blocks], pa.binary())],
            names=["block", "counts"],
        )


def _add_rows(batches):
    """Sums per block of what comes."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = np.frombuffer(x, "<f8")
            sums[k] = sums[k] + v if k in sums else v
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            names=["block", "counts"],
        )


def train(
    coded: DataFrame, vocabulary: Vocabulary, states: int = STATES, classes: int = CLASSES, passes: int = PASSES,
    start_rows: int = START_ROWS, start_passes: int = START_PASSES,
) -> Model:
    """Baum-Welch over all rows that are learned from.

    With `start_passes`, that many passes come first, over a 32nd of the rows (`start_rows` at
    least), and then one over each share twice as large.
    """
    mass = class_mass(vocabulary, classes)
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    learned = coded.where("learned").select("ids", draw.alias("draw"))
    model, n = first_model(mass, states), learned.count()
    if not n:
        return model
    if start_passes:
        share = min(1.0, max(START_SHARE, start_rows / n))
        some = cut_lineage(learned.where(F.col("draw") < F.lit(share)))
        for _ in range(start_passes):
            model = one_pass(some, model, mass, classes)
        while (share := 2 * share) < 1:
            model = one_pass(learned.where(F.col("draw") < F.lit(share)), model, mass, classes)
    for _ in range(passes):
        model = one_pass(learned, model, mass, classes)
    return model


def one_pass(rows: DataFrame, model: Model, mass: np.ndarray, classes: int) -> Model:
    """The next model, from the expected counts of all rows."""
    run = partial(_expected_rows, model=model, classes=classes)
    sums = rows.select("ids").mapInArrow(run, "block int, counts binary")
    # Added up by block in as many tasks; one row per block comes back.
    found = sums.repartition("block").mapInArrow(_add_rows, "block int, counts binary").collect()
    by_block = {r["block"]: np.frombuffer(r["counts"], "<f8").reshape(-1, model.states) for r in found}
    if not by_block:
        return model
    words = np.concatenate([by_block[k] for k in range(len(by_block) - 1)])
    return refit((by_block[-1][0], by_block[-1][1:], words), mass)


def class_mass(vocabulary: Vocabulary, classes: int) -> np.ndarray:
    """Shares of the classes, each with one more than it has been seen."""
    counts = vocabulary.counts[: classes + 1].astype(float)
    counts[0] = vocabulary.tokens - counts[1:].sum()
    return (counts + 1) / (counts + 1).sum()


# Scores


def _score_rows(batches, model, vocabulary, classes, log_rest):
    """Forward likelihoods, and what frequent words add to both scores."""
    logs = np.log10(vocabulary.counts + 1.0)
    spread = np.where(np.arange(len(logs)) > classes, logs, 0.0)  # frequent words within class 0
    for b in small_batches(batches, 4 << 20):
        ids = [np.frombuffer(x, "<u2").astype(np.int64) for x in b.column(4).to_pylist()]
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        begin = np.append(0, np.cumsum(lengths)[:-1])
        out = np.zeros(len(ids))
        for run in chain.by_length(lengths):
            steps = chain.Steps(lengths[run])
            seq = np.empty(int(lengths[run].sum()), dtype=np.int64)
            seq[steps.place] = class_of(np.concatenate([ids[i] for i in run]), classes)
            _, scale = chain.forward(steps, model.start, model.move, model.emit[seq], keep=False)
            starts = np.flatnonzero(np.append(True, np.diff(steps.sequence) > 0))
            out[run] = np.add.reduceat(np.log(scale[steps.place]), starts) / _LN10
        add = lambda v: np.add.reduceat(v, begin) if len(flat) else np.zeros(len(ids))
        shared = (flat == 0) | (flat > classes)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), b.column(2), b.column(3), pa.array(add((flat > 0).astype(np.int64))),
                pa.array(add(logs[flat])), pa.array(out + add(spread[flat]) - add(shared.astype(float)) * log_rest),
            ],
            names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "likelihood"],
        )


def score(coded: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Model, classes: int = CLASSES) -> DataFrame:
    """Base and model scores of coded rows, in log10."""
    in_class = vocabulary.counts[1 : classes + 1]
    seen = vocabulary.tokens - int(in_class.sum()) + vocabulary.words - len(in_class)
    run = partial(_score_rows, model=model, vocabulary=vocabulary, classes=classes, log_rest=math.log10(seen + 1))
    main = coded.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, likelihood double"
    )
    rare = coded.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    # Words that are frequent are not asked for, so no key of this join is hot in training.
    found = rare.join(counts, "word").groupBy("row").agg(
        F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_logs")
    )
    both = main.join(found, "row", "left").na.fill(0, ["rare_known", "rare_logs"])
    return both.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * F.lit(vocabulary.log_base)).alias("base_score"),
        (F.col("likelihood") + F.col("rare_logs")).alias("score"),
    )


def op9_hmm_lm(
    spark: SparkSession, folder: str, states: int = STATES, classes: int = CLASSES, frequent: int = FREQUENT
) -> DataFrame:
    """Unigram and hidden Markov scores of every document."""
    held, learned = in_training()
    docs = whole_text(documents(spark, folder)).select("doc_id", held.alias("held_out"), learned.alias("learned"), "text")
    counts = cut_lineage(word_counts(docs.where("learned")))
    vocabulary = vocabulary_of(counts, frequent)
    coded = cut_lineage(docs.mapInArrow(partial(_code_rows, number=vocabulary.number), CODED))
    model = train(coded, vocabulary, states, classes)
    return score(coded, counts, vocabulary, model, classes)
