"""SimHash near-duplicates by a self-join of a binary trie.

A text's fingerprint has a bit where more than half of the hashes of its word
shingles have it. Equal fingerprints are brought together first. The distinct
ones form a binary trie, most evenly set bits first; pairs of its nodes are
walked down together, adding up the bits in which the two sides differ, and a
pair is left as soon as it differs in more than `budget` bits.

The walk is cut at a depth that follows the number of fingerprints: below it,
each node is a task's work. A fingerprint goes to its own node and, with what it
has already spent of the budget, to every later node that the walk still
reaches, which are at most (1 + depth + depth^2 / 2) / 2 on average for a budget
of 2. A task gives out only links that connect what it holds, so a large group
gives no more links than it has members; connected components follow.

Null text and text without words have the fingerprint zero, which links like any
other. Rows that repeat, also with the same doc_id, each give a row. A null
doc_id never names a component, unless there is no other. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.rows import documents, small_batches, whole_text
from tidemark.operators.components import components
from tidemark.session import cut_lineage

SHINGLE, BUDGET, NODE_ROWS = 3, 2, 4096
BITS = 64
PAIRS_AT_ONCE = 1 << 18
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
_BYTE_PLACE = 256 * np.arange(8, dtype=np.int64)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().translate(_LOWER).split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 bits, each set if it is in more than half of the shingles' hashes; as a signed number."""
    import xxhash

    grams = shingles(words_of(text), size)
    if not grams:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    places = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_PLACE
    seen = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ _BITS_OF_BYTE).ravel() * 2 > len(grams)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (a signed long) of every row."""
    return with_print(whole_text(df), "doc_id long", size)


def with_print(rows: DataFrame, kept: str, size: int = SHINGLE) -> DataFrame:
    """The `kept` columns of `rows`, in its order, with `print`. The text is the last column."""
    names = [*rows.columns[:-1], "print"]

    def run(batches):
        for b in small_batches(batches):
            prints = [fingerprint(t, size) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints, pa.int64())], names=names)

    return rows.mapInArrow(run, f"{kept}, print long")


# The trie. Values have their bits in trie order, the first one highest.


def reorder(values: np.ndarray, order: list[int]) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.uint64)
    for bit in order:
        out = (out << np.uint64(1)) | ((values >> np.uint64(bit)) & np.uint64(1))
    return out


def walk(values: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, budget: int):
    """Pairs of places in sorted `values` that differ in at most `budget` bits.

    `pairs` are nodes at `depth` as ranges of places (left from, left to, right
    from, right to) and the bits in which they differ so far.
    """
    todo, small = [(depth, pairs)], 32
    while todo:
        depth, (a, b, c, d, spent) = todo.pop()
        same = (a == c) & (b == d)
        live = (b > a) & (d > c) & (spent <= budget) & ~(same & (b - a < 2))
        a, b, c, d, spent, same = (x[live] for x in (a, b, c, d, spent, same))
        if not len(a):
            continue
        # Small pairs of nodes are compared value by value.
        sizes = (b - a) * (d - c)
        tiny = (sizes <= small) if depth < BITS else np.ones(len(a), dtype=bool)
        if tiny.any():
            yield from _compare(values, a[tiny], b[tiny], c[tiny], d[tiny], budget)
        rest = ~tiny
        a, b, c, d, spent, same = (x[rest] for x in (a, b, c, d, spent, same))
        if not len(a):
            continue
        shift = np.uint64(BITS - 1 - depth)
        mid = lambda lo: ((values[lo] >> shift) | np.uint64(1)) << shift  # noqa: E731  first value of the right child
        m, n = np.searchsorted(values, mid(a)), np.searchsorted(values, mid(c))
        m, n = np.clip(m, a, b), np.clip(n, c, d)
        across = ~same
        nxt = (
            np.concatenate([a, m, a, m[across]]),
            np.concatenate([m, b, m, b[across]]),
            np.concatenate([c, n, n, c[across]]),
            np.concatenate([n, d, d, n[across]]),
            np.concatenate([spent, spent, spent + 1, spent[across] + 1]),
        )
        # The deepest pairs come next, some at a time: what waits stays small.
        todo += [(depth + 1, tuple(x[i : i + PAIRS_AT_ONCE] for x in nxt)) for i in range(0, len(nxt[0]), PAIRS_AT_ONCE)]


def _compare(values, a, b, c, d, budget, at_once: int = 1 << 20):
    sizes = (b - a) * (d - c)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(a):
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + at_once)))
        n = sizes[begin:stop]
        which = np.repeat(np.arange(begin, stop), n)
        k = np.arange(int(n.sum())) - np.repeat(ends[begin:stop] - n - base, n)
        wide = (d - c)[which]
        left, right = a[which] + k // wide, c[which] + k % wide
        near = (left != right) & (np.bitwise_count(values[left] ^ values[right]) <= budget)
        yield left[near], right[near]
        begin = stop


def connecting(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place that it is connected with."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root


def _place_rows(batches, order, depth, budget):
    """Every fingerprint at its own node and at later ones that the walk reaches."""
    masks = np.array(
        sorted({0} | {m for m in _masks(depth, budget)}), dtype=np.uint64
    )
    spent = np.bitwise_count(masks)
    for b in small_batches(batches, 1 << 16):
        v = reorder(b.column(0).to_numpy().view(np.uint64), order)
        home = v >> np.uint64(BITS - depth) if depth else np.zeros(len(v), np.uint64)
        node = home[:, None] ^ masks[None, :]
        keep = node >= home[:, None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(node[keep].astype(np.int64)),
                pa.array(np.broadcast_to(v.view(np.int64)[:, None], node.shape)[keep]),
                pa.array(np.broadcast_to(spent[None, :], node.shape)[keep].astype(np.int32)),
            ],
            names=["node", "value", "spent"],
        )


def _masks(depth: int, budget: int):
    """Numbers of `depth` bits with 1 to `budget` bits set."""
    found = {0}
    for _ in range(min(budget, depth)):
        found |= {m | (1 << i) for m in found for i in range(depth)}
    return found


def _node_links(rows: pd.DataFrame, order, depth, budget) -> pd.DataFrame:
    values = rows["value"].to_numpy().view(np.uint64)
    spent = rows["spent"].to_numpy().astype(np.int64)
    at = np.argsort(values, kind="stable")
    values, spent = values[at], spent[at]
    # Visitors of one node lie together, as does the node itself: it is where nothing is spent.
    node = values >> np.uint64(BITS - depth) if depth else np.zeros(len(values), np.uint64)
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    end = np.append(begin[1:], len(values))
    home = np.flatnonzero(spent[begin] == 0)
    if not len(home):
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    h = home[0]
    wide = lambda x: np.full(len(begin), x, dtype=np.int64)
    pairs = (begin.astype(np.int64), end.astype(np.int64), wide(begin[h]), wide(end[h]), spent[begin])
    root = np.arange(len(values))
    for left, right in walk(values, pairs, depth, budget):
        if len(left):
            keep = root[left] != root[right]
            if keep.any():
                joined = connecting(root[left[keep]], root[right[keep]], len(values))
                root = joined[root]
    linked = np.flatnonzero(root != np.arange(len(values)))
    undo = [order.index(BITS - 1 - i) for i in range(BITS)]  # back to the places the bits had
    undo = [BITS - 1 - p for p in undo]
    back = reorder(values, undo).view(np.int64)
    return pd.DataFrame({"u": back[linked], "v": back[root[linked]]})


def links(prints: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """u, v: links between distinct fingerprints (column `print`) that connect all near ones."""
    counted = prints.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(F.shiftrightunsigned("print", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(BITS)),
    ).first()
    n = counted["n"]
    order = sorted(range(BITS), key=lambda i: (abs(2 * (counted[f"b{i}"] or 0) - n), i))
    depth = min(BITS // 2, max(0, math.ceil(math.log2(max(n, 1) / node_rows))))
    place = partial(_place_rows, order=order, depth=depth, budget=budget)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _node_links(rows, order, depth, budget)

    placed = prints.select("print").mapInArrow(place, "node long, value long, spent int")
    return placed.groupBy("node").applyInPandas(run, "u long, v long").distinct()


def groups(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, print and component_id from doc_id and print."""
    prints = cut_lineage(prints)
    reps = cut_lineage(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    edges = cut_lineage(links(reps, budget))
    members = components(edges.select(F.lit(0).alias("g"), "u", "v")).select(F.col("node").alias("print"), "root")
    named = reps.join(members, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = named.groupBy("root").agg(F.min("least").alias("component_id")).join(named.select("root", "print"), "root")
    # Stored, so that Spark knows its size; large groups of equal prints are split by the adaptive join.
    return prints.join(cut_lineage(named.select("print", "component_id")), "print")


def keep_one(df: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """`df` with one row of each group of linked fingerprints: the one with the smallest doc_id, then text hash.

    Null ids come last. Of equal rows one stays. All columns are kept.
    """
    text = F.coalesce("text", F.lit(""))
    text_id = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    packed = df.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc"), text_id.alias("text_id"), text.alias("text"))
    prints = cut_lineage(with_print(packed.select("doc", "text_id", "text"), "doc long, text_id binary", size))
    first = F.struct(F.col("doc").isNull().alias("none"), "doc", "text_id")
    reps = cut_lineage(prints.groupBy("print").agg(F.min(first).alias("least")))
    edges = cut_lineage(links(reps, budget))
    members = components(edges.select(F.lit(0).alias("g"), "u", "v")).select(F.col("node").alias("print"), "root")
    kept = reps.join(members, "print", "left").groupBy(F.coalesce("root", "print")).agg(F.min("least").alias("k"))
    kept = kept.select(F.col("k.doc").alias("doc"), F.col("k.text_id").alias("text_id"), F.lit(True).alias("stays"))
    same = [F.col("a.text_id") == F.col("b.text_id"), F.col("a.doc").eqNullSafe(F.col("b.doc"))]
    counts = prints.groupBy("doc", "text_id").agg(F.count(F.lit(1)).alias("n"))
    judged = counts.alias("a").join(kept.alias("b"), same, "left").select("a.doc", "a.text_id", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    # Rows that go, and rows that are there more than once, are the fewer: they are sent to the texts.
    odd = cut_lineage(judged.where("not stays or n > 1"))
    # Beyond small tables they are too many to be sent to every task: the texts are shuffled once, at every size.
    out = packed.alias("a").join(odd.hint("merge").alias("b"), same, "left_anti").select("row")
    repeated = odd.where("stays")
    if not repeated.isEmpty():
        again = packed.alias("a").join(repeated.alias("b"), same, "left_semi").dropDuplicates(["doc", "text_id"])
        out = out.union(again.select("row"))
    return out.select("row.*")


def op3_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of three-word shingles and groups of those within two bits."""
    found = groups(fingerprints(documents(spark, folder)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
