"""Near copies of texts: an exact set-similarity join on word shingles.

Texts that are equal are one. Two texts are near if the Jaccard similarity of
their sets of five-word shingles is at least 0.8; no pair is lost. It is found
in two steps, both by the prefix bound: put in any one order, the first
n - ceil(0.8 n) + k of n shingles of each text have k of them in common.

In order of their hashes, a text that has a near one shares a part of its first
shingles with other texts, and texts that do not go no further. Of those that do,
shingles are put in order of how many texts have them, and texts meet by the
heads of their lists. First only neighbours along a list are compared, which
ties most of a large group; then texts of different groups meet, and those of
one group do not. All pairs are compared exactly before any link is left out, and
connected components of those at or above the limit are the groups.

Of a group the row with the least doc_id stays (null last; then by the text's
hash); of rows that repeat doc_id and text any one. Null texts are equal to each
other and near to nothing, and so are texts without words. All columns pass.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.rows import small_batches
from tidemark.llm.simhash import SEED, connecting, shingles, words_of
from tidemark.operators.components import components
from tidemark.operators.spread import spread_join
from tidemark.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
SHARED = 10  # one in so many shingles more is looked at to see whether a text can have a near one
BLOCK_ROWS = 2000
GRAM_BYTES = 8 << 20
SLACK = 1e-9


def gram_set(text: str, size: int) -> np.ndarray:
    """Hashes of the distinct shingles in ascending order."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in shingles(words_of(text), size)], dtype="<u8"))


def most_apart(n: int, similarity: float) -> int:
    """How many of n shingles a near text may lack."""
    return n - int(np.ceil(similarity * n - SLACK))


def _first_rows(batches, size, similarity):
    """The first shingles of each text, and how many of them it must share to have a near one."""
    more = lambda n: max(1, n // SHARED)
    for b in small_batches(batches):
        own, names, needs = [], [], []
        for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            grams = gram_set(text, size)
            if n := len(grams):
                apart = most_apart(n, similarity)
                own.append(grams[: apart + more(n)])
                names.append(name)
                needs.append(more(n - apart))  # a near text may be smaller and show fewer
        sizes = [len(g) for g in own]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64)),
                pa.array(np.repeat(np.array(names, np.int64), sizes)),
                pa.array(np.repeat(np.array(needs, np.int64), sizes)),
            ],
            names=["hash", "text", "need"],
        )


def _met_rows(batches):
    """Of rows in order of hash and text those whose hash another text has too."""
    held, met = np.empty((3, 0), dtype=np.int64), False

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.array(rows[2])], names=["text", "need"])

    for b in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], axis=1)
        if not rows.shape[1]:
            continue
        fresh = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
        rows = rows[:, fresh]
        like = rows[0, 1:] == rows[0, :-1]
        shared = np.append(met, like) | np.append(like, False)
        held, met = rows[:, -1:], bool(shared[-1])
        yield out(rows[:, :-1][:, shared[:-1]])
    if met:
        yield out(held)


def may_have_near(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """`text`: keys of the texts that may have a near one, from (key, text)."""
    firsts = texts.mapInArrow(
        partial(_first_rows, size=size, similarity=similarity), "hash long, text long, need long"
    )
    met = firsts.repartition("hash").sortWithinPartitions("hash", "text").mapInArrow(_met_rows, "text long, need long")
    counted = met.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
    return counted.where("n >= need").select("text")


def _set_rows(batches, size):
    for b in small_batches(batches):
        sets = [gram_set(text, size) for text in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["text_id", "n", "grams"],
        )


def _gram_rows(batches):
    for b in small_batches(batches, GRAM_BYTES):
        grams = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype="<i8")
        n = b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(grams)],
            names=["text", "n", "hash"],
        )


def heads(grams: DataFrame, similarity: float) -> DataFrame:
    """The rarest shingles of each text, one of which a near text has in its own; `at` is the place in the order.

    Shingles of one text only come first in it, and can be left out: they bring nobody together.
    """
    posts = grams.select("text", "n", "grams").mapInArrow(_gram_rows, "text long, n int, hash long")
    df = posts.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = W.partitionBy("text")
    single = F.col("n") - F.count(F.lit(1)).over(own)
    at = (single + F.row_number().over(own.orderBy("df", "hash"))).cast("int")
    ranked = spread_join(posts, df, ["hash"], "df", ["text"]).withColumn("at", at)
    beyond = F.ceil(F.lit(similarity) * F.col("n") - SLACK).cast("int") - 1
    head = ranked.withColumn("beyond", beyond).where("at <= n - beyond")
    parts = F.ceil(F.col("df") / BLOCK_ROWS).cast("int")
    part = F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")
    return head.withColumn("parts", parts).select("hash", "text", "n", "at", "beyond", "parts", part.alias("part"))


def _fits(a: str, b: str, similarity: float):
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - SLACK


def forest(left: np.ndarray, right: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Numbers of links that connect as much as all of them do, light ones first."""
    root, kept = np.arange(n), []
    for w in np.unique(weight):
        at = np.flatnonzero((weight == w) & (root[left] != root[right]))
        if not len(at):
            continue
        a, b = np.minimum(root[left[at]], root[right[at]]), np.maximum(root[left[at]], root[right[at]])
        _, first = np.unique(a * n + b, return_index=True)
        own: dict[int, int] = {}

        def find(x):
            while x in own:
                x = own[x]
            return x

        for k in first.tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                own[max(x, y)] = min(x, y)
                kept.append(at[k])
        root = connecting(root[left[at]], root[right[at]], n)[root]
    return np.array(kept, dtype=np.int64)


def _similar_rows(batches, similarity):
    """Of the pairs those that are near; of a batch so many of them that they connect what all do."""
    for b in batches:
        near, gap = [], []
        for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both):
                near.append(k)
                gap.append(len(x) + len(y) - 2 * both)
        u, v = (b.column(c).to_numpy()[near] for c in (0, 1))
        names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        keep = forest(place[: len(u)], place[len(u) :], np.array(gap, dtype=np.int64), len(names))
        yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])


def similar(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """u, v: of the pairs (i, j) that are near enough to connect them all; only links that were checked are thinned."""
    side = lambda text, s: grams.select(F.col("text").alias(text), F.col("grams").alias(s))
    both = pairs.join(side("i", "x"), "i").join(side("j", "y"), "j").select("i", "j", "x", "y")
    return both.mapInArrow(partial(_similar_rows, similarity=similarity), "u long, v long")


def neighbours(head: DataFrame, similarity: float) -> DataFrame:
    """i, j: texts that stand next to each other in a good part of the lists of their heads."""
    along = W.partitionBy("hash", "part").orderBy("n", "text")
    pairs = head.withColumns({"i": F.lag("text", 1).over(along), "m": F.lag("n", 1).over(along)})
    pairs = pairs.where(F.col("i").isNotNull() & _fits("n", "m", similarity))
    pairs = pairs.groupBy("i", F.col("text").alias("j")).agg(
        F.count(F.lit(1)).alias("s"), F.min(F.col("n") - F.col("beyond")).alias("length")
    )
    return pairs.where(F.col("s") * 4 >= F.col("length")).select("i", "j")


def across(head: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """i, j: texts of different groups that may be near; `groups` has text and root.

    For every shingle the texts outside its largest group meet the rest.
    """
    grouped = head.join(groups, "text", "left").withColumn("comp", F.coalesce("root", "text")).drop("root")
    per = grouped.groupBy("hash", "comp").agg(F.count(F.lit(1)).alias("_n"))
    main = per.groupBy("hash").agg(
        F.max_by("comp", F.struct("_n", "comp")).alias("main"), F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_m")
    )
    mixed = cut_lineage(spread_join(grouped, main.where("_k > 1"), ["hash"], "_m", ["text"]).drop("_k", "_m"))
    used = ("text", "n", "at", "beyond", "comp", "main")
    side = lambda df, s: df.select("hash", "part", *[F.col(c).alias(f"{c}_{s}") for c in used])
    lefts = mixed.where("comp <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = side(lefts, "l").join(side(mixed, "r"), ["hash", "part"])
    low = F.col("text_l") < F.col("text_r")
    apart = (F.col("comp_l") != F.col("comp_r")) & ((F.col("comp_r") == F.col("main_r")) | low)
    pick = lambda c, first: F.when(low if first else ~low, F.col(f"{c}_l")).otherwise(F.col(f"{c}_r"))
    ends = [pick(c, first).alias(f"{c}{s}") for c in ("n", "beyond") for s, first in (("i", True), ("j", False))]
    met = pairs.where(apart & _fits("n_l", "n_r", similarity)).groupBy(
        F.least("text_l", "text_r").alias("i"), F.greatest("text_l", "text_r").alias("j"), *ends
    ).agg(F.count(F.lit(1)).alias("s"), F.max(pick("at", True)).alias("ati"), F.max(pick("at", False)).alias("atj"))
    # Shingles not counted yet lie beyond one head and after the last shared one of the other.
    rest = F.greatest(
        F.least("beyondi", F.col("nj") - F.col("atj")), F.least("beyondj", F.col("ni") - F.col("ati"))
    )
    needed = F.lit(similarity / (1 + similarity)) * (F.col("ni") + F.col("nj")) - SLACK
    return met.where(F.col("s") + rest >= needed).select("i", "j")


def near_links(texts: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: links that connect all near texts, from (text_id, text), one row per text_id (or equal ones)."""
    named = texts.withColumn("key", F.xxhash64("text_id"))
    wanted = cut_lineage(may_have_near(named.select("key", "text"), size, similarity).withColumnRenamed("text", "key"))
    some = named.join(wanted, "key", "left_semi").select("text_id", "text")
    sets = some.mapInArrow(partial(_set_rows, size=size), "text_id binary, n int, grams binary")
    sets = sets.dropDuplicates(["text_id"])
    # Numbered when it is stored, so the numbers stay.
    grams = cut_lineage(sets.select(F.monotonically_increasing_id().alias("text"), "text_id", "n", "grams"))
    head = cut_lineage(heads(grams, similarity))
    first = cut_lineage(similar(neighbours(head, similarity), grams, similarity))
    groups = cut_lineage(components(first.withColumn("g", F.lit(0))).select(F.col("node").alias("text"), "root"))
    second = similar(cut_lineage(across(head, groups, similarity)), grams, similarity)
    name = lambda c: grams.select(F.col("text").alias(c), F.col("text_id").alias(f"{c}_id"))
    links = first.union(second).join(name("u"), "u").join(name("v"), "v")
    return links.select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))


def keep_one(df: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """`df` with one row of each group of equal or near texts."""
    columns = df.columns
    text = F.coalesce("text", F.lit(""))
    text_id = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias("doc"), text.alias("text"),
        text_id.alias("text_id"),
    )
    prints = cut_lineage(packed.select("doc", "text_id"))
    order = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"))
    texts = cut_lineage(prints.groupBy("text_id").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")))
    # Of equal texts one is looked at.
    copies = prints.join(texts.where("n > 1").select("text_id", "least"), "text_id")
    copies = cut_lineage(copies.where("not (doc <=> least.doc)").select("doc", "text_id").distinct())
    same = [F.col("a.text_id") == F.col("b.text_id"), F.col("a.doc").eqNullSafe(F.col("b.doc"))]
    once = packed.select("doc", "text_id", "text").alias("a").join(copies.alias("b"), same, "left_anti")
    links = cut_lineage(near_links(once.select("text_id", "text"), size, similarity))
    groups = components(links.select(F.lit(0).alias("g"), "u", "v")).select(F.col("node").alias("text_id"), "root")
    named = texts.select("text_id", "least").join(groups, "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    kept = named.groupBy("root").agg(F.min(F.struct("least", "text_id")).alias("k"))
    kept = cut_lineage(kept.select(F.col("k.least.doc").alias("doc"), F.col("k.text_id").alias("text_id")))
    # What goes is less than what stays: it is what is sent to the texts.
    counts = prints.groupBy("doc", "text_id").agg(F.count(F.lit(1)).alias("n"))
    judged = counts.alias("a").join(kept.withColumn("stays", F.lit(True)).alias("b"), same, "left")
    judged = judged.select("a.doc", "a.text_id", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    odd = cut_lineage(judged.where("not stays or n > 1"))
    rows = packed.select("row", "doc", "text_id").alias("a")
    out = rows.join(odd.alias("b"), same, "left_anti").select("row")
    repeated = odd.where("stays")
    if not repeated.isEmpty():
        again = rows.join(repeated.alias("b"), same, "left_semi").dropDuplicates(["doc", "text_id"])
        out = out.union(again.select("row"))
    return out.select("row.*")
