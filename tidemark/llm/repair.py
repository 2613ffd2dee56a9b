"""Token ids in files, compressed by Re-Pair grammars with random access.

Documents in ascending doc_id order (nulls first, then by a hash of the text)
are dealt into shards by range. A shard is a run of blocks of about
`block_ids` ids; documents stay whole. In a block the pairs of neighbouring ids
that occur at least `least` times are replaced by nonterminals, round after round,
until no pair is that frequent; of a run of one symbol every second place is taken
in one round. A grammar a block, not a shard: a shard of any size is then read and
written block by block, in bounded memory, and a lost task costs its own blocks. A row of a file is one block: its
rules, how many ids each rule expands to, the compressed sequence, and doc_id
and id count of its documents. `read_range` expands only the symbols that cover
the ids asked for.

Null text counts as empty: its document is the end id alone. Rows that repeat,
also with the same doc_id, are documents of their own. Other columns are
ignored. An empty table gives files without blocks.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.bpe import encoder, vocabulary
from tidemark.llm.rows import documents, small_batches, task_number, whole_text
from tidemark.session import cut_lineage, new_path

BLOCK_IDS, LEAST, END_ID = 1 << 18, 4, 1  # a rule is two symbols: below four places it saves next to nothing
BUCKETS = 1 << 16

BLOCK = (
    "shard long, block long, n_ids long, terminals long, n_docs long, no_doc_id binary, doc_ids binary, "
    "doc_tokens binary, rules binary, rule_ids binary, sequence binary"
)
_FIELDS = [c.split() for c in BLOCK.split(", ")]
SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.binary()) for n, t in _FIELDS])


def frequent_pairs(seq: np.ndarray, least: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (as left * 2^32 + right) that occur at least `least` times among the places `at`, most
    frequent first; the places where they stand, and the rank of the pair there."""
    left, right = seq[at], seq[at + 1]
    # A pair is no more frequent than its bucket: few places are left to be counted exactly.
    bucket = (left * np.uint32(40_503) + right).astype(np.uint16)
    often = np.flatnonzero(np.take(np.bincount(bucket, minlength=BUCKETS) >= least, bucket))
    pairs, order = _sorted_pairs(left[often], right[often])
    begin = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
    counts = np.diff(np.append(begin, len(pairs)))
    kept = counts >= least
    rank = np.full(len(begin), -1, dtype=np.int32)
    rank[kept] = np.argsort(np.argsort(-counts[kept], kind="stable"), kind="stable")
    found = np.empty(int(kept.sum()), dtype=np.int64)
    found[rank[kept]] = pairs[begin[kept]]
    of_place = np.full(len(at), -1, dtype=np.int32)
    of_place[often[order]] = np.repeat(rank, counts)
    stands = of_place >= 0
    return found, at[stands], of_place[stands]


def _sorted_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as left * 2^32 + right) in order, and the places they come from."""
    n = len(left)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide, places = int(right.max()).bit_length(), (n - 1).bit_length()
    if int(left.max()).bit_length() + wide + places > 63:
        pairs = (left.astype(np.int64) << 32) | right
        order = np.argsort(pairs)
        return pairs[order], order
    # Pair and place in one number: sorting numbers is several times faster than sorting their places.
    key = (((left.astype(np.int64) << wide) | right) << places) | np.arange(n)
    key.sort()
    order = key & ((1 << places) - 1)
    key >>= places
    return ((key >> wide) << 32) | (key & ((1 << wide) - 1)), order


def compress(ids: np.ndarray, terminals: int, least: int = LEAST):
    """The sequence of symbols, and rules as rows of two symbols."""
    seq, rules = ids.astype(np.uint32), []
    made = 0
    open_at = np.ones(len(seq), dtype=bool)
    while len(seq) > 1:
        found, places, rank = frequent_pairs(seq, least, np.flatnonzero(open_at[:-1]))
        if not len(found):
            break
        # A pair that is rare now stays rare: only frequent pairs and pairs with a new symbol are looked at again.
        open_at[:] = False
        open_at[places] = True
        # Of a run of one symbol the pairs that overlap are left out: every second place stays.
        goes_on = 1 + np.flatnonzero((places[1:] - places[:-1] == 1) & (rank[1:] == rank[:-1]))
        if len(goes_on):
            start = np.flatnonzero(np.append(True, np.diff(goes_on) != 1))
            nth = np.arange(len(goes_on)) - np.repeat(start, np.diff(np.append(start, len(goes_on))))
            apart = np.ones(len(places), dtype=bool)
            apart[goes_on[nth % 2 == 0]] = False
            places, rank = places[apart], rank[apart]
        # Where chosen pairs overlap the more frequent wins, among equals the first.
        touch = places[1:] - places[:-1] == 1
        wins = np.ones(len(places), dtype=bool)
        wins[1:] &= ~touch | (rank[1:] < rank[:-1])
        wins[:-1] &= ~touch | (rank[:-1] <= rank[1:])
        take = places[wins]
        rank = rank[wins]
        stands = np.bincount(rank, minlength=len(found)) > 0
        used, new = np.flatnonzero(stands), (np.cumsum(stands) - 1)[rank]
        rules.append(np.stack([found[used] >> 32, found[used] & 0xFFFFFFFF], axis=1).astype(np.uint32))
        seq[take] = terminals + made + new
        made += len(used)
        open_at[take] = True
        open_at[take[take > 0] - 1] = True
        stays = np.ones(len(seq), dtype=bool)
        stays[take + 1] = False
        seq, open_at = seq[stays], open_at[stays]
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return seq, table


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out = np.zeros(len(rules), dtype=np.int64)
    at = np.arange(len(rules))
    left, right = rules[:, 0].astype(np.int64) - terminals, rules[:, 1].astype(np.int64) - terminals
    while len(at):  # a level of the grammar at a time
        size = lambda r: np.where(r < 0, 1, out[np.maximum(r, 0)])
        a, b = size(left[at]), size(right[at])
        ready = (a > 0) & (b > 0)
        out[at[ready]] = (a + b)[ready]
        at = at[~ready]
    return out.astype(np.uint32)


def expand(seq: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of symbols. The ids of every rule that is used are worked out once and laid out one after the other."""
    if len(seq) <= len(rules):  # few symbols: not worth working out all rules
        return _level_by_level(seq, rules, terminals)
    ends = np.cumsum(rule_lengths(rules, terminals).astype(np.int64))
    if not len(ends) or ends[-1] > 16 * len(seq):  # rules of very long runs
        return _level_by_level(seq, rules, terminals)
    flat = _level_by_level(terminals + np.arange(len(rules), dtype=rules.dtype), rules, terminals)
    rule = seq.astype(np.int64) - terminals
    big = rule >= 0
    rule = rule[big]
    sizes = np.ones(len(seq), dtype=np.int64)
    sizes[big] = np.diff(ends, prepend=0)[rule]
    stop = np.cumsum(sizes)
    # Where an id lies in the ids of all rules; symbols that are ids themselves are put in afterwards.
    shift = np.zeros(len(seq), dtype=np.int64)
    shift[big] = ends[rule] - stop[big]
    at = np.arange(int(stop[-1])) + np.repeat(shift, sizes)
    single = stop[~big] - 1
    at[single] = 0
    out = flat[at]
    out[single] = seq[~big]
    return out


def _level_by_level(seq: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """Every nonterminal becomes its two symbols, until there are none."""
    out = seq
    while len(at := np.flatnonzero(out >= terminals)):
        pair = rules[out[at] - terminals]
        sizes = np.ones(len(out), dtype=np.int64)
        sizes[at] = 2
        place = at + np.arange(len(at))
        out = np.repeat(out, sizes)
        out[place], out[place + 1] = pair[:, 0], pair[:, 1]
    return out


class Block:
    """One stored block, ready for reading."""

    def __init__(self, row: dict):
        self.terminals = row["terminals"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["rule_ids"], "<u4")
        self.seq = np.frombuffer(row["sequence"], "<u4")

    def read(self) -> np.ndarray:
        return expand(self.seq, self.rules, self.terminals)

    def read_range(self, start: int, count: int) -> np.ndarray:
        """`count` ids from `start` on; only the symbols over them are expanded."""
        sizes = np.ones(len(self.seq), dtype=np.int64)
        big = self.seq >= self.terminals
        sizes[big] = self.lengths[self.seq[big] - self.terminals]
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + count, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return expand(self.seq[a:b], self.rules, self.terminals)[skip : skip + count]


def _block_rows(batches, path, block_ids, least):
    enc = encoder(path)
    terminals, shard = enc.tok.get_vocab_size(), task_number()
    end = np.array([END_ID], dtype=enc.dtype).tobytes()
    docs, parts, size, number = [], [], 0, 0

    def block():
        ids = enc.ids(b"".join(parts))
        seq, rules = compress(ids, terminals, least)
        counts = np.array([len(p) // enc.dtype.itemsize for p in parts], "<u8")
        row = {
            "shard": shard, "block": number, "n_ids": len(ids), "terminals": terminals, "n_docs": len(docs),
            "no_doc_id": np.array([d is None for d in docs], "u1").tobytes(),
            "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
            "doc_tokens": counts.tobytes(), "rules": rules.astype("<u4").tobytes(),
            "rule_ids": rule_lengths(rules, terminals).astype("<u4").tobytes(),
            "sequence": seq.astype("<u4").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    for b in small_batches(batches):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            docs.append(doc_id)
            parts.append(enc.encode(text) + end)
            size += len(parts[-1]) // enc.dtype.itemsize
            if size >= block_ids:
                yield block()
                docs, parts, size, number = [], [], 0, number + 1
    if docs:
        yield block()


def write(df: DataFrame, folder: str, path: str, block_ids: int = BLOCK_IDS, least: int = LEAST) -> None:
    """Ids of all documents, each with the end id, as blocks in files in `folder`."""
    docs = whole_text(df).withColumn("tie", F.xxhash64("text"))
    run = partial(_block_rows, path=path, block_ids=block_ids, least=least)
    (
        docs.repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(run, BLOCK)
        .write.option("compression", "zstd")
        .parquet(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with `first`, the number of ids in all blocks before.

    Sums of shards are few (one per write task), so they are added up in one
    place; blocks only within their shard.
    """
    blocks = spark.read.schema(BLOCK).parquet(folder)
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_first"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    firsts = places.join(shards, "shard").select("shard", "block", (F.col("inside") + F.col("shard_first")).alias("first"))
    # Stored, so that Spark knows its size and sends it to all tasks only when it is small.
    return blocks.join(cut_lineage(firsts), ["shard", "block"])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _document_rows(batches, digest):
    for b in batches:
        for row in b.to_pylist():
            ids = Block(row).read()
            counts = np.frombuffer(row["doc_tokens"], "<u8").astype(np.int64)
            ends = np.cumsum(counts)
            data = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8)
            cuts = [data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
            names = pa.array(
                np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["no_doc_id"], "u1").astype(bool)
            )
            last = pa.array([zlib.crc32(c) for c in cuts], pa.int64()) if digest else pa.array(
                [c.tobytes() for c in cuts], pa.binary()
            )
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(row["first"] + ends - counts), pa.array(counts), last],
                names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (4 bytes each) of every document in the files."""
    return read(spark, folder).mapInArrow(
        partial(_document_rows, digest=False), "doc_id long, start long, n_tokens long, ids binary"
    )


def op8_repair_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as Re-Pair blocks and read back from the files."""
    files = new_path(spark, "token-ids")
    write(documents(spark, folder), files, vocabulary("word_bpe_49k.json"))
    return read(spark, files).mapInArrow(
        partial(_document_rows, digest=True), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
