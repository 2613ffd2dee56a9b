"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors of integers, floor(scale * x), are put in order of their label and, within
it, of their place on a Hilbert curve through the dimensions that vary most. The
ordered rows are stored as Parquet in blocks of about `block_rows`, in folders of
neighbouring blocks. A block's zone map has the least and the greatest component
of each dimension, and the least and the greatest label.

A search asks for the first rows whose score, the inner product, lies in a window,
among rows of the anchor's label or of other labels. Interval arithmetic on a zone
map bounds every score in its block from below and above: a block whose label range
or score bounds miss all windows of an anchor is not read for it, and folders that no
anchor needs are not read at all. A search goes in two steps: each anchor reads the
`SEEDS` blocks with the highest bounds first; the scores found there raise the lower
ends of its windows before the other blocks are chosen. Bounds and scores are sums of
integers, so nothing is lost.

The first search is for the positives, the best rows of the anchor's label; each of
their scores gives a window for the second one. Anchors and zone maps meet in chunks,
anchors and blocks meet block by block: a block's rows come first, anchors stream past.

Rows with a null label or a vector that is null or holds null or non-finite
components take no part. Rows are told apart by themselves, not by vec_id: repeated
rows each count, and each is an anchor of its own. A null vec_id comes last among
ties. Shorter vectors are filled up with zeros. Integers beyond 2**20 in size count
as 2**20, so that scores are exact. A positive without negatives gives no row, nor
does an anchor without positives or an empty table. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.rows import embeddings, small_batches, task_number
from tidemark.session import cut_lineage, new_path

SCALE, LIMIT = 256, 1 << 20
BLOCK_ROWS, RANGE_BLOCKS, FOLDERS = 512, 16, 256
CURVE_DIMS, CURVE_BITS = 15, 4  # 60 bits: a key is a long
SEEDS = 2
ZONES_AT_ONCE, ANCHORS_AT_ONCE = 256, 2048
FAR = 1 << 62


def integers(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (array of int, all of one length) of the rows that take part."""
    fine = F.expr(
        "label is not null and embedding is not null and "
        "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    )
    rows = df.where(fine).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    width = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    whole = lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return rows.select("vec_id", "label", F.concat(F.transform("embedding", whole), F.array_repeat(F.lit(0), F.lit(width) - F.size("embedding"))).alias("v"))


# Blocks


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers below 2**bits (the transpose method)."""
    x = [c.copy() for c in cells.T.astype(np.int64)]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inside, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(cells), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    key = np.zeros(len(cells), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> b) & 1)
    return key


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def with_curve(rows: DataFrame) -> DataFrame:
    """The rows with `curve`, their place on the curve; one row of statistics is read for its grid."""
    width = (rows.select(F.size("v")).first() or [0])[0]
    each = [f(F.col("v")[d].cast("double")) for d in range(width) for f in (F.min, F.max, F.var_pop)]
    seen = np.array([x or 0.0 for x in rows.agg(F.count(F.lit(1)), *each).first()[1:]], dtype=float).reshape(-1, 3)
    dims = np.lexsort((np.arange(len(seen)), -seen[:, 2]))[:CURVE_DIMS]
    low, high = seen[dims, 0], seen[dims, 1]

    def run(batches):
        for b in small_batches(batches):
            v = matrix(b.column(2), b.num_rows)[:, dims]
            cells = ((v - low) * (1 << CURVE_BITS) // np.maximum(high - low + 1, 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(cells, CURVE_BITS))], names=["vec_id", "label", "v", "curve"])

    return rows.mapInArrow(run, "vec_id long, label long, v array<int>, curve long") if width else rows.withColumn("curve", F.lit(0).cast("long"))


def _cut(batches, block_rows, per_folder):
    """Numbers for the rows of a range in order: row, block and folder."""
    base, at = task_number() << 32, 0
    for b in small_batches(batches):
        place = np.arange(at, at + b.num_rows, dtype=np.int64)
        at += b.num_rows
        folder = np.full(b.num_rows, task_number() // per_folder, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array(base + place), pa.array((base >> 8) + place // block_rows), pa.array(folder)],
            names=["vec_id", "label", "v", "row", "block", "folder"],
        )


def store_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows as of `integers`, stored by block: vec_id, label, v, row, block, folder."""
    rows = cut_lineage(rows)
    ranges = max(1, -(-rows.count() // (block_rows * RANGE_BLOCKS)))
    ordered = with_curve(rows).repartitionByRange(ranges, "label", "curve", "vec_id").sortWithinPartitions("label", "curve", "vec_id", "v")
    cut = partial(_cut, block_rows=block_rows, per_folder=-(-ranges // FOLDERS))
    schema = "vec_id long, label long, v array<int>, row long, block long, folder int"
    path = new_path(rows.sparkSession, "blocks")
    ordered.select("vec_id", "label", "v").mapInArrow(cut, schema).write.partitionBy("folder").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def zone_maps(blocks: DataFrame) -> DataFrame:
    """block, folder, least and greatest label, low and high (least and greatest components)."""
    width = (blocks.select(F.size("v")).first() or [1])[0]
    ends = lambda f: F.array(*(f(F.col("v")[d]) for d in range(width)))
    return blocks.groupBy("block", "folder").agg(
        F.min("label").alias("label_low"), F.max("label").alias("label_high"), ends(F.min).alias("low"), ends(F.max).alias("high")
    )


# Which blocks an anchor must read


def bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each vector with anything between low and high."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _choose(batches, same_label, seeds):
    """Blocks per anchor. Zone maps of a cell come before its anchors."""
    cell, zones, table = None, [], None
    for b in small_batches(batches):
        cells, kinds = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])))
        for lo, hi in zip(edges, np.append(edges[1:], len(cells))):
            part = b.slice(lo, hi - lo)
            if cells[lo] != cell:
                cell, zones, table = cells[lo], [], None
            if not kinds[lo]:
                zones.append(part)
                continue
            if table is None:
                whole = pa.Table.from_batches(zones).combine_chunks()
                many = lambda c: matrix(whole.column(c).chunk(0), whole.num_rows).astype(float)
                table = [whole.column(c).to_numpy() for c in ("id", "folder", "label", "label_high")] + [many("low"), many("high")] if zones else []
            if not table:
                continue
            block, folder, first, last, low, high = table
            n = part.num_rows
            label, v = part.column(4).to_numpy(), matrix(part.column(6), n).astype(float)
            least, most = matrix(part.column(8), n), matrix(part.column(9), n)
            under, over = bounds(v, low, high)
            if same_label:
                fits = (first[None] <= label[:, None]) & (label[:, None] <= last[None])
            else:
                fits = (first[None] != label[:, None]) | (last[None] != label[:, None])
            meets = np.zeros_like(fits)
            for w in range(least.shape[1]):
                a, z = least[:, w, None], most[:, w, None]
                meets |= (a <= z) & (over >= a) & (under <= z)
            i, k = np.nonzero(fits & meets)
            if seeds:  # the best blocks of each anchor
                order = np.lexsort((block[k], -over[i, k], i))
                i, k = i[order], k[order]
                start = np.searchsorted(i, i)
                keep = np.arange(len(i)) - start < seeds
                i, k = i[keep], k[keep]
            if len(i):
                row = part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[i]), pa.array(block[k]), pa.array(folder[k]), pa.array(over[i, k])], names=["row", "block", "folder", "most"]
                )


def choose(zones: DataFrame, asked: DataFrame, same_label: bool, seeds: int = 0) -> DataFrame:
    """row, block, folder and upper bound of the blocks that anchors must read, or of their `seeds` best ones."""
    groups = max(1, -(-zones.count() // ZONES_AT_ONCE))
    chunks = max(1, -(-asked.count() // ANCHORS_AT_ONCE))
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    group, chunk = F.pmod(F.xxhash64("block"), F.lit(groups)), F.pmod(F.xxhash64("row"), F.lit(chunks))
    none = lambda kind: F.lit(None).cast(kind)
    left = zones.select("*", group.alias("g"), F.explode(number(chunks)).alias("c")).select(
        (F.col("g") * chunks + F.col("c")).cast("int").alias("cell"), F.lit(False).alias("is_anchor"), F.col("block").alias("id"),
        "folder", F.col("label_low").alias("label"), "label_high", "low", "high", none("array<long>").alias("least"), none("array<long>").alias("most"),
    )
    right = asked.select("*", chunk.alias("c"), F.explode(number(groups)).alias("g")).select(
        (F.col("g") * chunks + F.col("c")).cast("int").alias("cell"), F.lit(True).alias("is_anchor"), F.col("row").alias("id"),
        none("int").alias("folder"), "label", none("long").alias("label_high"), F.col("v").alias("low"), none("array<int>").alias("high"),
        F.col("least"), F.col("most"),
    )
    met = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "is_anchor")
    found = met.mapInArrow(partial(_choose, same_label=same_label, seeds=seeds), "row long, block long, folder int, most double")
    if not seeds:
        return found
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("most"), "block"))
    return found.withColumn("best", best).where(F.col("best") <= seeds).drop("best")


# Reading blocks


def firsts(group: np.ndarray, score: np.ndarray, null: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group: highest score, then smallest vec_id."""
    order = np.lexsort((row, vec_id, null, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _read(batches, same_label, k, at_once=256):
    """The first rows of each window of each anchor in each block. A block's rows come before its anchors."""
    block, parts, held = None, [], None
    for b in small_batches(batches):
        blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])))
        for lo, hi in zip(edges, np.append(edges[1:], len(blocks))):
            part = b.slice(lo, hi - lo)
            if blocks[lo] != block:
                block, parts, held = blocks[lo], [], None
            if not kinds[lo]:
                parts.append(part)
                continue
            if held is None:
                whole = pa.Table.from_batches(parts).combine_chunks()
                ids = whole.column("vec_id")
                held = (
                    whole.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy().astype(np.int8),
                    whole.column("label").to_numpy(), matrix(whole.column("v").chunk(0), whole.num_rows).astype(float),
                )
            row, vec_id, null, label, v = held
            for at in range(0, part.num_rows, at_once):
                own = part.slice(at, at_once)
                n = own.num_rows
                who, least, most = own.column(2).to_numpy(), matrix(own.column(6), n), matrix(own.column(7), n)
                score = (matrix(own.column(5), n).astype(float) @ v.T).astype(np.int64)
                fits = (own.column(4).to_numpy()[:, None] == label[None]) == same_label
                fits &= who[:, None] != row[None]
                for w in range(least.shape[1]):
                    i, j = np.nonzero(fits & (score >= least[:, w, None]) & (score <= most[:, w, None]))
                    if not len(i):
                        continue
                    top = firsts(i, score[i, j], null[j], vec_id[j], row[j], k)
                    i, j = i[top], j[top]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(who[i]), pa.array(np.full(len(i), w, dtype=np.int32)), pa.array(vec_id[j], mask=null[j].astype(bool)), pa.array(row[j]), pa.array(score[i, j])],
                        names=["row", "window", "vec_id", "other", "score"],
                    )


def read(blocks: DataFrame, chosen: DataFrame, asked: DataFrame, same_label: bool, k: int) -> DataFrame:
    """row, window, vec_id, other (row) and score of up to k rows per window and chosen block."""
    chosen = cut_lineage(chosen.select("row", "block", "folder"))
    folders = [r[0] for r in chosen.select("folder").distinct().collect()]  # FOLDERS at most
    needed = blocks.where(F.col("folder").isin(folders)).join(chosen.select("block").distinct(), "block", "left_semi")
    none = F.lit(None).cast("array<long>")
    left = needed.select("block", F.lit(False).alias("is_anchor"), "row", "vec_id", "label", "v", none.alias("least"), none.alias("most"))
    right = chosen.join(asked, "row").select("block", F.lit(True).alias("is_anchor"), "row", F.lit(None).cast("long").alias("vec_id"), "label", "v", "least", "most")
    met = left.unionByName(right).repartition("block").sortWithinPartitions("block", "is_anchor")
    found = met.mapInArrow(partial(_read, same_label=same_label, k=k), "row long, window int, vec_id long, other long, score long")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return found.select("row", "window", "vec_id", "other", "score", F.row_number().over(first).alias("rank")).where(F.col("rank") <= k)


def first_in_windows(blocks: DataFrame, zones: DataFrame, asked: DataFrame, k: int, same_label: bool, seeds: int = SEEDS) -> DataFrame:
    """row, window, rank, vec_id, other and score of the first k rows in every window of every anchor.

    `asked` has row, label, v and the windows' ends, least and most, as arrays of one length.
    """
    begun = cut_lineage(choose(zones, asked, same_label, seeds))
    some = cut_lineage(read(blocks, begun, asked, same_label, k))
    full = some.groupBy("row", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    raised = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))  # one entry a window
    done = begun.groupBy("row").agg(F.collect_list("block").alias("done"))  # `seeds` at most
    now = asked.join(raised, "row", "left").join(done, "row", "left")
    higher = F.transform("least", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w.cast("int")), x)))
    now = cut_lineage(now.select("row", "label", "v", higher.alias("least"), "most", F.coalesce("done", F.array().cast("array<long>")).alias("done")))
    others = choose(zones, now, same_label).join(now.select("row", "done"), "row").where(~F.array_contains("done", F.col("block")))
    more = read(blocks, others, now, same_label, k)
    return cut_lineage(ranked(some.drop("rank").unionByName(more.drop("rank")), k))


def mine(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.

    `df` has vec_id, label and embedding; `is_anchor` is a condition on vec_id and
    label. A positive's negatives are the first rows of other labels whose score is
    `low` to `high` hundredths of the positive's.
    """
    blocks = store_blocks(integers(df), block_rows)
    zones = cut_lineage(zone_maps(blocks))
    anchors = cut_lineage(blocks.where(is_anchor).select("row", "vec_id", "label", "v"))
    always = lambda x: F.array(F.lit(x).cast("long"))
    asked = anchors.select("row", "label", "v", always(-FAR).alias("least"), always(FAR).alias("most"))
    found = first_in_windows(blocks, zones, asked, positives, same_label=True)
    # Exact ceilings and floors of hundredths.
    least, most = -F.floor(F.expr(f"-{low} * score / 100d")), F.floor(F.expr(f"{high} * score / 100d"))
    window = F.struct(F.col("rank").cast("int").alias("rank"), least.cast("long").alias("least"), most.cast("long").alias("most"))
    windows = found.groupBy("row").agg(F.sort_array(F.collect_list(window)).alias("w"))  # `positives` at most
    # One length for all: windows that are not there are empty.
    empty = F.array_repeat(F.struct(F.lit(0).alias("rank"), F.lit(FAR).alias("least"), F.lit(-FAR).alias("most")), positives - F.size("w"))
    wide = windows.select("row", F.concat("w", empty).alias("w")).select("row", F.col("w.least").alias("least"), F.col("w.most").alias("most"))
    asked = cut_lineage(anchors.select("row", "label", "v").join(wide, "row"))
    missed = first_in_windows(blocks, zones, asked, negatives, same_label=False)
    good = found.select("row", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    bad = missed.select("row", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return bad.join(good, ["row", "window"]).join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_zone_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Five hard negatives for each of five positives of every 100th vector; some labels are moved first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings(spark, folder).select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


SQL = f"""
WITH f AS (
  SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: greatest(least(floor(256 * x::DOUBLE), {LIMIT}), -{LIMIT})::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(range(1, least(len(a.v), len(c.v)) + 1), lambda i: a.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM f a JOIN f c ON a.vec_id % 100 = 0 AND a.r <> c.r),
p AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r))::INTEGER AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
