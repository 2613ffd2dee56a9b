"""BPE encoding and decoding by tree concatenation.

A text of up to `leaf_chars` characters is one leaf and is encoded where it is
read. A longer text, also one without any space, is cut into leaves at fixed
places whatever stands there; the leaves travel as rows of their own, so that
many tasks encode one text. Then neighbours are put together two by two: a
window around the join is encoded again and grows until it agrees with both
sides (`Encoder.join`), which gives exactly the ids of the whole text.

Null text counts as empty: no ids. Rows that repeat, also with the same doc_id,
each give a row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.bpe import encoder, vocabulary
from tidemark.llm.rows import documents, small_batches, task_number, whole_text

LEAF_CHARS = 16_384
ENCODED = "doc_id long, ids binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _encode_rows(batches, path):
    enc = encoder(path)
    for b in small_batches(batches):
        cols = [b.column(i) for i in range(b.num_columns - 1)]
        ids = [enc.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(ids, pa.binary())], names=[*b.schema.names[:-1], "ids"]
        )


def _cut_rows(batches, path, leaf_chars):
    """Leaves of long texts: row (made here), segment between special tokens, leaf."""
    specials = encoder(path).specials
    parts_at = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    row = task_number() << 40
    for b in small_batches(batches):
        out = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            segments = parts_at.split(text) if parts_at else [text]
            for s, segment in enumerate(segments):
                for k, at in enumerate(range(0, len(segment), leaf_chars)):
                    out.append((row, doc_id, s, k, segment[at : at + leaf_chars]))
            row += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), _arrow(LEAF).types)], schema=_arrow(LEAF)
        )


LEAF = "row long, doc_id long, segment int, leaf int, text string"


def _join_rows(batches, path):
    """Leaves in order of row, segment and leaf to the ids of whole texts."""
    enc = encoder(path)
    row, doc, segment, parts, done = None, None, None, [], []

    def whole():
        ids = np.concatenate([*done, enc.join_all(parts)])
        return pa.RecordBatch.from_pydict({"doc_id": [doc], "ids": [ids.tobytes()]}, schema=_arrow(ENCODED))

    for b in batches:
        for r, d, s, _, ids in zip(*(b.column(i).to_pylist() for i in range(5))):
            if r != row:
                if row is not None:
                    yield whole()
                row, doc, segment, parts, done = r, d, s, [], []
            elif s != segment:
                done.append(enc.join_all(parts))
                segment, parts = s, []
            parts.append(enc.ids(ids))
    if row is not None:
        yield whole()


def encode(df: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and ids (little-endian, 2 or 4 bytes each) of every row's whole text."""
    docs = whole_text(df)
    is_long = F.length("text") > leaf_chars
    short = docs.where(~is_long).mapInArrow(partial(_encode_rows, path=path), ENCODED)
    leaves = docs.where(is_long).mapInArrow(partial(_cut_rows, path=path, leaf_chars=leaf_chars), LEAF)
    encoded = leaves.repartition("row", "leaf").mapInArrow(
        partial(_encode_rows, path=path), "row long, doc_id long, segment int, leaf int, ids binary"
    )
    joined = (
        encoded.repartition("row")
        .sortWithinPartitions("row", "segment", "leaf")
        .mapInArrow(partial(_join_rows, path=path), ENCODED)
    )
    return short.unionByName(joined)


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encoded rows, special tokens kept."""

    def run(batches):
        enc = encoder(path)
        for b in small_batches(batches, 1 << 20):
            texts = enc.tok.decode_batch([enc.ids(x).tolist() for x in b.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digest_rows(batches, path):
    """Round trips as digests: ids are written in decimal, joined by commas."""
    enc = encoder(path)
    words = np.array([f"{i}," for i in range(enc.tok.get_vocab_size())], dtype="S")
    for b in small_batches(batches, 1 << 20):
        ids = [enc.ids(x) for x in b.column(1).to_pylist()]
        texts = enc.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        # Numbers of different width are padded with zero bytes, which then go.
        written = [words[x].tobytes().translate(None, b"\0")[:-1] for x in ids]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in written], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
            ],
            schema=_arrow(DIGEST),
        )


def op2_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents and the texts decoded from them, as digests."""
    path = vocabulary("byte_bpe_50k.json")
    return encode(documents(spark, folder), path).mapInArrow(partial(_digest_rows, path=path), DIGEST)
