"""Benchmark decontamination: a prefix-filtered set join with exact containment.

An item is cut into windows of `window` words, a shorter one is a window of its
own, and a window's set is its shingles of `shingle` words (a window of fewer
words has itself). A window lies in a document only if all of its shingles do, so
one of them is enough to find it by: the prefix. Shingles are ordered by how often
documents have them, and the rarest of a window is its prefix, so that common
wording brings no candidates. A place of the prefix in a document gives the one
place where the window could begin; length and position bounds say whether it can
lie there. Containment is then checked exactly: the window's first and last
shingle, and those between them that are needed to cover every word, must stand in
the document at their places. Shingles are compared as text, not as hashes.

Texts are read once. What stays of them is a row per document with its number of
words, and a row per place of a shingle that some window has. The shingles of the
benchmark are broadcast only if their characters were counted and are within
`broadcast_chars`; beyond that Spark joins by shuffle, and its skew rule splits hot
shingles. Words of a document are counted as hit by merging intervals.

Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z are
lower-cased, nothing else. Null text and text without words give a row without
hits. Repeated rows each give a row. Rows with equal item_id are one item; items
without an id are one item whose name is empty. Without items nothing is hit.
Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.rows import documents
from tidemark.session import cut_lineage

WINDOW, SHINGLE = 10, 5
BROADCAST_CHARS = 16 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a text column, A-Z in lower case; none for null."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def runs(of: Column, length: int) -> Column:
    """Every run of `length` words as (start, text), from place 0 on."""
    last = F.size(of) - length
    text = lambda i: F.concat_ws(" ", *(F.get(of, i + k) for k in range(length)))
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("start"), text(i).alias("run")))
    return F.when(last >= 0, each).otherwise(F.expr("cast(array() as array<struct<start:int,run:string>>)"))


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item, window (its text), length and shingles (start, run) of every different window of every item."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("w"))
    split = split.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("length"))
    cut = split.select("item", "length", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.col("length")))).alias("w"))
    parts = F.when(F.col("length") >= shingle, runs(F.col("w"), shingle)).otherwise(
        F.array(F.struct(F.lit(0).alias("start"), F.array_join("w", " ").alias("run")))
    )
    return cut.select("item", F.array_join("w", " ").alias("window"), "length", parts.alias("shingles")).distinct()


def places(docs: DataFrame, wanted: DataFrame, lengths: list[int], broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """A row for the first shingle of each document, and one for each shingle that is `wanted` (column run).

    Columns doc_id, text_hash, n_words, start and run; run is null where it is not wanted.
    """
    size = wanted.agg(F.coalesce(F.sum(F.length("run") + 16), F.lit(0))).first()[0]
    wanted = wanted.select("run", F.lit(True).alias("is_wanted"))
    side = F.broadcast(wanted) if size <= broadcast_chars else wanted
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("w"))
    found = F.flatten(F.array(*(runs(F.col("w"), n) for n in lengths)))
    rows = split.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.posexplode_outer(found).alias("k", "at"))
    rows = rows.select("doc_id", "text_hash", "n_words", "k", F.col("at.start").alias("start"), F.col("at.run").alias("run"))
    joined = rows.join(side, "run", "left")
    kept = joined.where(F.col("is_wanted") | F.coalesce(F.col("k") == 0, F.lit(True)))
    return kept.select(
        "doc_id", "text_hash", "n_words", "start", F.when(F.col("is_wanted"), F.col("run")).alias("run"),
        F.coalesce(F.col("k") == 0, F.lit(True)).alias("is_first"),
    )


def occurrences(at: DataFrame, cut: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, window, start and length of every place where a window lies, each once."""
    hits = at.where("run is not null").select("doc_id", "text_hash", "n_words", "start", "run").distinct()
    own = cut.select("window", "length", "shingles").distinct()
    often = hits.groupBy("run").count()
    parts = own.select("window", "length", F.explode("shingles").alias("s")).select("window", "length", "s.start", "s.run")
    # Windows with a shingle that no document has are gone here: they can lie in none.
    ranked = parts.join(often, "run")
    rarest = ranked.groupBy("window", "length").agg(
        F.min(F.struct("count", "run", "start")).alias("prefix"), F.count(F.lit(1)).alias("n_found")
    )
    whole = F.greatest(F.col("length") - shingle + 1, F.lit(1))
    rarest = rarest.where(F.col("n_found") == whole)
    prefix = rarest.select("window", "length", F.col("prefix.run").alias("run"), F.col("prefix.start").alias("offset"))
    begin = F.col("start") - F.col("offset")
    candidates = hits.join(prefix, "run").select("doc_id", "text_hash", "n_words", "window", "length", begin.alias("start"))
    candidates = candidates.where("start >= 0 and start + length <= n_words")
    # Shingles that cover the window: every `shingle` words, and the last one.
    last = F.greatest(F.col("length") - shingle, F.lit(0))
    steps = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(shingle)), F.array(last)))
    cover = own.select("window", F.explode("shingles").alias("s"), steps.alias("steps"))
    cover = cover.where(F.array_contains("steps", F.col("s.start"))).groupBy("window").agg(
        F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.run").alias("run"))).alias("cover")
    )
    asked = candidates.join(cover, "window").withColumn("n_cover", F.size("cover"))
    asked = asked.select("doc_id", "text_hash", "window", "length", "start", "n_cover", F.explode("cover").alias("s"))
    asked = asked.withColumns({"place": F.col("start") + F.col("s.start"), "run": F.col("s.run")}).drop("s")
    there = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("start").alias("p"), F.col("run").alias("r"))
    same = (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("text_hash") == F.col("h")) & (F.col("place") == F.col("p")) & (F.col("run") == F.col("r"))
    sure = asked.join(there, same, "left_semi").groupBy("doc_id", "text_hash", "window", "length", "start", "n_cover").count()
    return sure.where(F.col("count") == F.col("n_cover")).select("doc_id", "text_hash", "window", "start", "length")


def covered(found: DataFrame) -> DataFrame:
    """doc_id, text_hash and n_hit: words that lie in any of the windows, each counted once."""
    spans = found.groupBy("doc_id", "text_hash", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    doc = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    before = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))
    spans = spans.withColumn("new", F.greatest(new, F.lit(0)))
    return spans.groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_chars: int = BROADCAST_CHARS
) -> DataFrame:
    """doc_id, n_words, n_hit and items (sorted names of items with a window in the document) of every row."""
    cut = cut_lineage(windows(items, window, shingle))
    wanted = cut.select(F.explode("shingles.run").alias("run")).distinct()
    # Lengths of shingles: at most `shingle` different numbers.
    lengths = sorted(r[0] for r in cut.select(F.least("length", F.lit(shingle))).distinct().collect()) or [shingle]
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    at = cut_lineage(places(docs, cut_lineage(wanted), lengths, broadcast_chars))
    found = cut_lineage(occurrences(at, cut, shingle))
    names = cut.select("window", "item").distinct()
    of_doc = found.select("doc_id", "text_hash", "window").distinct().join(names, "window")
    listed = of_doc.select("doc_id", "text_hash", "item").distinct().groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list("item")).alias("items")
    )
    key = lambda d: d.withColumns({"d": F.col("doc_id"), "h": F.col("text_hash")}).drop("doc_id", "text_hash")
    result = cut_lineage(key(covered(found)).join(
        key(listed).select(F.col("d").alias("d2"), F.col("h").alias("h2"), "items"),
        F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")),
    ).drop("d2", "h2"))
    rows = at.where("is_first").select("doc_id", "text_hash", "n_words")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    return rows.join(result, same, "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def op13_leak_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that repeat ten words of a benchmark item, and those items."""
    items = spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet")
    found = decontaminate(documents(spark, folder), items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, n, list_slice(w, s, s + n - 1) AS win FROM (
    SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
cut AS (
  SELECT r, n, s, list_slice(w, s, s + n - 1) AS win FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN lens ON len(w) >= n)),
found AS (SELECT cut.r, cut.s, cut.n, wins.item FROM cut JOIN wins ON cut.n = wins.n AND cut.win = wins.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN listed ON d.r = listed.r"""
