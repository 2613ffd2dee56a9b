"""Language identification by a linear-chain conditional random field.

Every word of a text gets scores from features of its own: affixes, character
n-grams and what a lexicon says. Learned transitions tie neighbouring words
together, and forward-backward gives each word its chance of every language, so
that words in code-switched text are labelled one by one. A text's language is
the one with the most expected words; its score is their share.

Learning takes at most about `rows_per_label` labelled texts of each language,
drawn by a hash, whole: their words have the language of their text, and runs of
texts are strung together so that changes of language are seen. Parts of the
sample are learned side by side from common weights, which are then averaged,
for a few rounds. The lexicon holds the `lexicon_words` most frequent words of
the sample.

Words are runs of letters. A run of more than 32 letters is cut into windows of 32,
each a word, and every character of a script written without spaces is one, so all of
a text is looked at and weighs by its length. Null text and text without letters is `und` with
score 0, and so is everything when no labelled row is there. Among equally
likely languages the first in order is taken. Rows that repeat each give a row;
a null doc_id is neither held out nor learned from. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm import chain
from tidemark.llm.rows import documents, small_batches
from tidemark.session import cut_lineage

ROWS_PER_LABEL, LEXICON_WORDS = 400, 20_000
FEATURES = 1 << 15
PARTS, ROUNDS, EPOCHS, RATE, STRING = 6, 3, 4, 0.5, 8
MEMO_WORDS = 250_000
CHARS_AT_ONCE = 1 << 20  # characters whose words are held at a time
RUN_ROWS = 1 << 18
WINDOW = 32  # letters of a run that are looked at together
# Fixed ranges: scripts written without spaces, whose characters are words of their own.
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\U00020000-\U0003134f"
)
_WORD = re.compile(rf"[{UNSPACED}]|[^\W\d_{UNSPACED}]{{1,{WINDOW}}}")


def words_of(text: str | None) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if has_letter(w)] if text else []


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Numbers of a word's features: affixes, n-grams, and the lexicon's levels per language."""
    edged = f"^{word}$"
    found = [f"<{word[:n]}" for n in (1, 2, 3)] + [f">{word[-n:]}" for n in (1, 2, 3, 4)]
    found += [edged[i : i + 2] for i in range(len(edged) - 1)] + [edged[i : i + 3] for i in range(len(edged) - 2)]
    found += [f"={label}:{level}" for label, level in enumerate(lexicon.get(word, ()))]
    return [zlib.crc32(f.encode()) % FEATURES for f in found]


@dataclass
class Model:
    labels: list[str]
    lexicon: dict[str, tuple[int, ...]]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels

    def scores(self, words: list[str]) -> np.ndarray:
        """What each word says for each label, as a factor of at most 1."""
        rows = [features(w, self.lexicon) for w in words]
        flat = np.fromiter((f for r in rows for f in r), dtype=np.int64)
        ends = np.cumsum([len(r) for r in rows])
        total = np.add.reduceat(self.weights[flat], np.append(0, ends[:-1]), axis=0)
        return factor(total)

    def start(self) -> np.ndarray:
        return np.full(len(self.labels), 1 / len(self.labels))


def factor(scores: np.ndarray) -> np.ndarray:
    """Factors from log scores; the floor keeps every label possible."""
    return np.exp(np.maximum(scores - scores.max(axis=-1, keepdims=True), -30))


def chances(model: Model, emit_of: np.ndarray, sequences: list[np.ndarray]):
    """(numbers of sequences, steps, chances of the labels by place) for runs of sequences."""
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    move = factor(model.moves)
    for run in chain.by_length(lengths, RUN_ROWS):
        steps = chain.Steps(lengths[run])
        emit = np.empty((int(lengths[run].sum()), len(model.labels)))
        emit[steps.place] = emit_of[np.concatenate([sequences[i] for i in run])]
        alpha, scale = chain.forward(steps, model.start(), move, emit)
        beta = chain.backward(steps, move, emit, scale)
        yield run, steps, emit, alpha, beta, scale, move


# Learning


def held_out(folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def sample(labelled: DataFrame, rows_per_label: int) -> DataFrame:
    """About `rows_per_label` rows of each label, by a hash, at random over `PARTS` parts."""
    counts = labelled.groupBy("lang").count()
    draw = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = labelled.join(F.broadcast(counts), "lang").where(draw < F.lit(float(rows_per_label)) / F.col("count"))
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(PARTS)).cast("int")
    return kept.select("lang", "text", F.xxhash64("text", "doc_id").alias("h"), part.alias("part"))


def learn_lexicon(rows: DataFrame, labels: list[str], size: int) -> dict[str, tuple[int, ...]]:
    """Per frequent word and label a level from 0 (hardly ever) to 3 (mostly)."""

    def count(batches):
        for b in small_batches(batches):
            out: dict[tuple[str, str], int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in words_of(text):
                    out[w, lang] = out.get((w, lang), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())],
                names=["word", "lang", "n"],
            )

    counted = rows.select("lang", "text").mapInArrow(count, "word string, lang string, n long")
    per_word = counted.groupBy("word").pivot("lang", labels).agg(F.sum("n")).na.fill(0)
    total = sum((F.col(f"`{x}`") for x in labels), F.lit(0))
    top = per_word.withColumn("total", total).where(F.col("total") >= 5).orderBy(F.desc("total"), "word").limit(size)
    shares = {r[0]: [n / r[-1] for n in r[1:-1]] for r in top.collect()}
    return {w: tuple(sum(p > x for x in (0.02, 0.3, 0.8)) for p in s) for w, s in shares.items()}


def _learn_part(rows: pd.DataFrame, model: Model) -> pd.DataFrame:
    """A few passes of gradient steps over one part of the sample."""
    rows = rows.sort_values(["h", "lang", "text"])
    label_of = {x: i for i, x in enumerate(model.labels)}
    number: dict[str, int] = {}
    texts = [
        (label_of[lang], np.array([number.setdefault(w, len(number)) for w in words_of(text)], dtype=np.int64))
        for lang, text in zip(rows["lang"], rows["text"])
    ]
    texts = [t for t in texts if len(t[1])]
    if not texts:
        return pd.DataFrame({"weights": [], "moves": []})
    strings = [texts[i : i + STRING] for i in range(0, len(texts), STRING)]
    sequences = [np.concatenate([t[1] for t in s]) for s in strings]
    truth = [np.concatenate([np.full(len(t[1]), t[0]) for t in s]) for s in strings]
    feats = [features(w, model.lexicon) for w in number]
    flat, owner = np.concatenate(feats).astype(np.int64), np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    begin = np.append(0, np.cumsum([len(f) for f in feats])[:-1])
    n_labels, n_words = len(model.labels), sum(map(len, sequences))
    weights, moves = model.weights.copy(), model.moves.copy()
    past_w, past_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(EPOCHS):
        now = Model(model.labels, model.lexicon, weights, moves)
        emit_of = factor(np.add.reduceat(weights[flat], begin, axis=0))
        grad_word, grad_move = np.zeros((len(feats), n_labels)), np.zeros_like(moves)
        for run, steps, emit, alpha, beta, scale, move in chances(now, emit_of, sequences):
            gap = -(alpha * beta)[steps.place]
            true = np.concatenate([truth[i] for i in run])
            gap[np.arange(len(true)), true] += 1
            words = np.concatenate([sequences[i] for i in run])
            for k in range(n_labels):
                grad_word[:, k] += np.bincount(words, gap[:, k], len(feats))
            same = steps.sequence[1:] == steps.sequence[:-1]
            np.add.at(grad_move, (true[:-1][same], true[1:][same]), 1.0)
            grad_move -= chain.transitions(steps, alpha, move, emit, scale, beta)
        grad = np.stack([np.bincount(flat, grad_word[owner, k], FEATURES) for k in range(n_labels)], axis=1) / n_words
        grad -= 1e-7 * weights
        grad_move = grad_move / n_words
        past_w += grad**2
        past_m += grad_move**2
        weights += RATE * grad / np.sqrt(past_w)
        moves += RATE * grad_move / np.sqrt(past_m)
    return pd.DataFrame({"weights": [weights.tobytes()], "moves": [moves.tobytes()]})


def _learner(model: Model):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _learn_part(rows, model)

    return run


def learn(
    labelled: DataFrame, rows_per_label: int = ROWS_PER_LABEL, lexicon_words: int = LEXICON_WORDS
) -> Model | None:
    """A model from rows with doc_id, text and lang; None when there are no labels."""
    known = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows = cut_lineage(sample(known, rows_per_label))
    labels = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not labels:
        return None
    lexicon = learn_lexicon(rows, labels, lexicon_words)
    model = Model(labels, lexicon, np.zeros((FEATURES, len(labels))), np.zeros((len(labels), len(labels))))
    for _ in range(ROUNDS):
        # One row of weights per part comes back: PARTS is their bound.
        got = rows.groupBy("part").applyInPandas(_learner(model), "weights binary, moves binary").collect()
        if not got:
            break
        mean = lambda name, shape: np.mean([np.frombuffer(r[name]).reshape(shape) for r in got], axis=0)
        model = Model(labels, lexicon, mean("weights", model.weights.shape), mean("moves", model.moves.shape))
    return model


# Prediction


class Labeller:
    """Remembers the scores of words within one Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.rows = 0
        self.emit = np.empty((1 << 12, len(self.model.labels)))

    def _learn(self, new: list[str]) -> None:
        real = [w for w in new if has_letter(w)]
        self.number.update((w, -1) for w in new)
        self.number.update((w, self.rows + k) for k, w in enumerate(real))
        if self.rows + len(real) > len(self.emit):
            grown = np.empty((max(2 * len(self.emit), self.rows + len(real)), self.emit.shape[1]))
            grown[: self.rows] = self.emit[: self.rows]
            self.emit = grown
        if real:
            self.emit[self.rows : self.rows + len(real)] = self.model.scores(real)
        self.rows += len(real)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Rows of `emit` for the words of each text. Words are forgotten only between calls."""
        if len(self.number) > MEMO_WORDS:
            self._forget()
        out, held, size = [], [], 0
        for text in [*texts, None]:
            held.append(text)
            size += len(text or "")
            if size > CHARS_AT_ONCE:
                out += self._numbers(held)
                held, size = [], 0
        return (out + self._numbers(held))[: len(texts)]

    def _numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        new: set[str] = set()
        for f in found:
            new.update(f)
        self._learn(sorted(new.difference(self.number)))
        get = self.number.__getitem__
        out = [np.fromiter(map(get, f), dtype=np.int32, count=len(f)) for f in found]
        return [x[x >= 0] if len(x) and x.min() < 0 else x for x in out]

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Per text the mean chance of each label over its words; rows of zeros for texts without letters."""
        sequences = self.numbers(texts)
        out = np.zeros((len(texts), len(self.model.labels)))
        for run, steps, _, alpha, beta, _, _ in chances(self.model, self.emit, sequences):
            gamma = (alpha * beta)[steps.place]
            starts = np.flatnonzero(np.append(True, np.diff(steps.sequence) > 0))
            sums = np.add.reduceat(gamma, starts, axis=0)
            out[run] = sums / sums.sum(axis=1, keepdims=True)
        return out

    def word_labels(self, text: str | None) -> list[tuple[str, str]]:
        words = words_of(text)
        if not words:
            return []
        emit = self.model.scores(words)
        for _, steps, _, alpha, beta, _, _ in chances(self.model, emit, [np.arange(len(words))]):
            best = (alpha * beta)[steps.place].argmax(axis=1)
        return [(w, self.model.labels[k]) for w, k in zip(words, best)]


def predict(df: DataFrame, model: Model | None) -> DataFrame:
    """The columns of `df` with lang_pred and score; only the text is looked at."""
    if model is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    columns = df.columns
    schema = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        labeller = Labeller(model)
        names = np.array([*model.labels, "und"], dtype=object)
        for b in small_batches(batches, 12 << 20):
            shares = labeller.shares(b.column(columns.index("text")).to_pylist())
            best = np.where(shares.any(axis=1), shares.argmax(axis=1), len(model.labels))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names[best], pa.string()), pa.array(np.minimum(shares.max(axis=1), 1.0))],
                names=[*columns, "lang_pred", "score"],
            )

    return df.mapInArrow(run, schema)


def label_words(df: DataFrame, model: Model) -> DataFrame:
    """doc_id and an array of (word, label) per row: the labels inside code-switched text."""

    def run(batches):
        labeller = Labeller(model)
        kind = pa.list_(pa.struct([("word", pa.string()), ("label", pa.string())]))
        for b in small_batches(batches):
            rows = [[{"word": w, "label": x} for w, x in labeller.word_labels(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "words"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<struct<word:string,label:string>>")


def op1_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document; learned from those that are not held out."""
    docs = documents(spark, folder).select(F.col("doc_id").cast("long"), "text", "lang")
    fold = docs.withColumn("held_out", held_out(5))
    model = learn(fold.where("not held_out and doc_id is not null"))
    return predict(fold.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
