"""Vector bin packing of token sequences by the dot-product heuristic.

Every sequence is a bin with three limits at once: tokens, segments (pieces of
examples) and loss-bearing tokens. A bin takes the example whose demands point
most along what the bin has left, weighed by the mean demands; what no example
fills, a cut of the best one that still has room does, so that bins end full unless
another limit stops them. Examples of more than a bin first give full bins of their
own, from the ids before its loss and those in it side by side, so that neither kind
is left over.

Loss-bearing are the ids behind a prompt, of a text without prompt those from the share
`loss_from` on (0: all). The segment limit binds where pieces are shorter than
`tokens / segments` on average; below that mean sequences cannot be full.

Rows are packed in the task that reads them: nothing is shuffled, a task holds
`pool` rests of examples at a time (more of very short ones, a few bins' worth), and
one or two bins per task are not full. Bins are numbered by task, so a repeated task
gives the same numbers.

Null text counts as empty: the example is then its end id alone. Rows that
repeat, also with the same doc_id, are examples of their own. Other columns are
ignored; a null or empty prompt counts as none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.bpe import encoder, vocabulary
from tidemark.llm.rows import documents, small_batches, task_number

TOKENS, SEGMENTS, POOL, END_ID = 2048, 1024, 512, 1
# Documents without prompts: the second half bears loss, and three quarters of a sequence at most do.
LOSS_TOKENS, LOSS_FROM = 1536, 0.5

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("loss_tokens", pa.int64()),
        ("ids", pa.binary()),
    ]
)


@dataclass
class Example:
    """What is left of an example: ids[start:end]; from `loss_at` on its ids bear loss."""

    doc_id: int | None
    ids: np.ndarray
    start: int
    loss_at: int
    end: int

    def left(self) -> int:
        return self.end - self.start

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_at))

    def fits(self, tokens: int, loss: int) -> int:
        """The longest cut within both limits."""
        return min(self.left(), tokens, max(0, self.loss_at - self.start) + loss)


class Packer:
    """Puts examples into bins; `add` and `finish` give finished pieces as tuples."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int, first_bin: int):
        if min(tokens, segments, loss, pool) < 1:
            raise ValueError("limits must be at least 1")
        self.limits = np.array([tokens, segments, loss], dtype=float)
        self.pool_size, self.pool, self.bin = pool, [], first_bin
        self.held = 0  # tokens in the pool

    def _piece(self, ex: Example, length: int, offset: int) -> tuple:
        ids = ex.ids[ex.start : ex.start + length].astype("<u4").tobytes()
        row = (ex.doc_id, ex.start, length, zlib.crc32(ids), len(ex.ids), self.bin, offset, ex.loss(length), ids)
        ex.start += length
        return row

    def add(self, ex: Example) -> Iterator[tuple]:
        tokens, segments, loss = map(int, self.limits)
        parts = [ex]
        if ex.left() > tokens and segments > 1 and ex.start < ex.loss_at < ex.end:
            parts = [
                Example(ex.doc_id, ex.ids, ex.start, ex.loss_at, ex.loss_at),
                Example(ex.doc_id, ex.ids, ex.loss_at, ex.loss_at, ex.end),
            ]
        while (both := sum(p.left() for p in parts)) >= tokens:
            bearing = min(parts[-1].loss(parts[-1].left()), loss, round(tokens * parts[-1].left() / both))
            lengths = [tokens - bearing, bearing] if len(parts) == 2 else [tokens]
            if any(n > p.left() for n, p in zip(lengths, parts)) or len(parts) == 1 and ex.loss(tokens) > loss:
                break
            offset = 0
            for n, p in zip(lengths, parts):
                if n:
                    yield self._piece(p, n, offset)
                    offset += n
            self.bin += 1
        self.pool += [p for p in parts if p.left()]
        self.held += both
        # Of very short examples more are waited for, until they fill several bins.
        if len(self.pool) >= self.pool_size and self.held >= 4 * tokens:
            yield from self._pack(self.pool_size // 4, 2 * tokens)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(0, 0)

    def _pack(self, keep: int, keep_tokens: int) -> Iterator[tuple]:
        """Fills bins until `keep` examples or `keep_tokens` tokens are left for the next ones."""
        pool = self.pool
        need = np.array([(e.left(), 1, e.loss(e.left())) for e in pool], dtype=float).reshape(-1, 3) / self.limits
        live = len(pool)
        while live > keep and self.held >= keep_tokens:
            left, offset = np.ones(3), 0
            weight = need[:live].mean(axis=0)
            while live and left[0] > 1e-9 and left[1] > 1e-9:
                score = need[:live] @ (weight * left)
                fit = (need[:live] <= left + 1e-9).all(axis=1)
                whole = fit.any()
                tokens, _, loss = np.rint(left * self.limits).astype(int)
                # Without room for loss only an example with ids before its loss can be cut.
                usable = fit if whole or loss else need[:live, 0] * self.limits[0] > need[:live, 2] * self.limits[2] + 0.5
                k = int(np.argmax(np.where(usable, score, -1.0) if whole or not loss else score))
                ex = pool[k]
                length = ex.left() if whole else ex.fits(tokens, loss)
                if length == 0:
                    break
                used = np.array([length, 1, ex.loss(length)]) / self.limits
                yield self._piece(ex, length, offset)
                offset += length
                self.held -= length
                left = left - used
                if ex.left():
                    need[k] = np.array([ex.left(), 1, ex.loss(ex.left())]) / self.limits
                else:
                    live -= 1
                    pool[k], need[k] = pool[live], need[live]
                    pool.pop()
            self.bin += 1


def _pack_rows(batches, path, tokens, segments, loss, pool, loss_from, with_ids):
    enc = encoder(path)
    packer = Packer(tokens, segments, loss, pool, first_bin=task_number() << 36)
    end = np.array([END_ID], dtype=enc.dtype)

    def out(rows):
        cols = list(zip(*rows)) if rows else [()] * len(PIECES)
        if not with_ids:
            cols[-1] = [None] * len(cols[0])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES)], schema=PIECES)

    for b in small_batches(batches):
        rows = []
        for doc_id, prompt, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            lead = enc.ids(enc.encode(prompt)) if prompt else enc.ids(b"")
            ids = np.concatenate([lead, enc.ids(enc.encode(text)), end])
            loss_at = len(lead) or int(loss_from * len(ids))
            rows += packer.add(Example(doc_id, ids, 0, loss_at, len(ids)))
        yield out(rows)
    enc.forget()
    yield out(list(packer.finish()))


def pack(
    df: DataFrame,
    path: str,
    tokens: int = TOKENS,
    segments: int = SEGMENTS,
    loss: int | None = None,
    pool: int = POOL,
    prompt: str | None = None,
    loss_from: float = 0.0,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it is from, which sequence holds it and where, and its ids.

    `prompt` names a column whose ids go before the text and bear no loss.
    `loss` limits the loss-bearing tokens of a sequence (default: as many as tokens);
    `loss_from` is the share of a text without prompt from which on its ids bear loss.
    """
    lead = F.col(prompt).cast("string") if prompt else F.lit(None).cast("string")
    rows = df.select(F.col("doc_id").cast("long"), lead.alias("lead"), F.coalesce("text", F.lit("")).alias("text"))
    run = partial(
        _pack_rows, path=path, tokens=tokens, segments=segments, loss=loss or tokens, pool=pool, loss_from=loss_from,
        with_ids=with_ids,
    )
    return rows.mapInArrow(
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "loss_tokens long, ids binary",
    )


def op5_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, at most 1024 segments and 1536 tokens of second halves."""
    path = vocabulary("byte_bpe_50k.json")
    return pack(documents(spark, folder), path, loss=LOSS_TOKENS, loss_from=LOSS_FROM, with_ids=False).drop("ids")
