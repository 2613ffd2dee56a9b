"""Delimited files from anywhere: line breaks, separators and backslashes inside quotes, in many tasks.

Whether a line stands inside a quoted field depends on every quote before it, so a
file cannot simply be cut at line breaks. Here each range of a file, as Spark splits
it, is scanned twice over: what would the state be after it if it began outside
quotes, and if it began inside? That is a function of two states; the functions of a
file's ranges are composed by a window over ranges (the last range whose end does not
depend on its start, and how many after it turn the state round), which gives every
range its true start. A second scan then cuts the records of its own range. A record
that crosses ranges comes out in pieces, which are put together by file and order.

Rules, those of the common readers: a field is quoted if it begins with a quote; a
doubled quote inside stands for one; what follows the closing quote belongs to the
field; quotes elsewhere are plain characters, and so are backslashes. Records end at
\\n, \\r\\n or \\r. The first record of a file is its header and is replaced by the given
names; a byte order mark before it is skipped. Blank lines are skipped. Missing
fields are null, surplus ones are dropped; a quote that never closes ends with the
file. Values listed in `missing` are null, and so is what does not parse as the
column's type.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from tidemark.session import cut_lineage

# What the common readers take as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
STATE_BYTES = 64 << 20  # ranges' states beyond this size are joined by shuffle
QUOTE = '"'
HEAD, MIDDLE, TAIL, RECORD = 0, 1, 2, 3


def after(line: str, inside: bool, ends: re.Pattern) -> bool:
    """Whether the text is inside quotes after a line that began inside them or not."""
    at, length = 0, len(line)
    if QUOTE not in line:
        return inside
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        elif at < length and line[at] == QUOTE:
            inside, at = True, at + 1
            continue
        found = ends.search(line, at)
        if not found:
            return False
        at = found.end()


def records(text: str, ends: re.Pattern) -> Iterator[str]:
    """Records of a text that begins and ends outside quotes: cut at lone carriage returns outside quotes."""
    if "\r" not in text[:-1]:
        yield text
        return
    start = at = 0
    while True:
        if text.startswith(QUOTE, at):  # to the end of the quoted part
            at += 1
            while (close := text.find(QUOTE, at)) >= 0 and text.startswith(QUOTE, close + 1):
                at = close + 2
            at = len(text) if close < 0 else close + 1
        found = ends.search(text, at)
        if not found:
            break
        at = found.end()
        if found.group() == "\r":
            yield text[start:at]
            start = at
    if start < len(text):
        yield text[start:]


def fields(texts: Iterable[str], sep: str, width: int) -> Iterator[list[str | None]]:
    """The fields of records, blank ones left out."""
    csv.field_size_limit(sys.maxsize)
    for row in csv.reader(texts, delimiter=sep):
        if row:
            yield row[:width] + [None] * (width - len(row))


def _ends(sep: str) -> re.Pattern:
    return re.compile(f"[{re.escape(sep)}\r]")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _functions(batches, sep):
    """Per range the state after it, for either state before it."""
    ends, now, states = _ends(sep), None, None
    out = lambda: pa.RecordBatch.from_pylist([dict(zip(("path", "start", "from_out", "from_in"), (*now, *states)))])
    for line, *key in _lines(batches):
        if key != now:
            if now:
                yield out()
            now, states = key, (False, True)
        if QUOTE in line:
            states = tuple(after(line, s, ends) for s in states) if states[0] != states[1] else (after(line, states[0], ends),) * 2
    if now:
        yield out()


def _cut(batches, sep, width):
    """Records of each range, and the pieces of those that begin or end in another one.

    Only pieces and the first record of a range carry the path and the start.
    """
    ends = _ends(sep)
    names = ["kind", "path", "start", "piece", "fields"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    # rows: what waits to be given out. held: lines of a record that is not at its end yet.
    now, rows, held, crossing, inside, first, size = None, [], [], False, False, False, 0
    for line, path, start, begins_inside in _lines(batches):
        if [path, start] != now:
            if held:
                rows.append((MIDDLE if crossing else TAIL, *now, "\n".join(held), None))
            now, held, crossing, inside, first = [path, start], [], begins_inside, begins_inside, True
        inside = after(line, inside, ends)
        held.append(line)
        size += len(line)
        if not inside:
            text, held = "\n".join(held), []
            if crossing:
                rows.append((HEAD, *now, text, None))
                crossing = False
            else:
                for f in fields(records(text, ends), sep, width):
                    rows.append((RECORD, *now, None, f) if first else (RECORD, None, None, None, f))
                    first = False
        if rows and (len(rows) >= 5000 or size > 8 << 20):
            yield pack(rows)
            rows, size = [], 0
    if held:
        rows.append((MIDDLE if crossing else TAIL, *now, "\n".join(held), None))
    if rows:
        yield pack(rows)


def _parse(batches, sep, width):
    """Records put together again. Only the first of a text, and thus of its file, can be the header."""
    ends = _ends(sep)
    for b in batches:
        for text, is_header in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = list(fields(records(text, ends), sep, width))[int(is_header) :]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["fields"])


def range_states(lines: DataFrame, sep: str) -> DataFrame:
    """path, start and begins_inside of every range of every file."""
    scanned = lines.select("value", "path", "start").mapInArrow(
        partial(_functions, sep=sep), "path string, start long, from_out boolean, from_in boolean"
    )
    scanned = cut_lineage(scanned)
    order = W.partitionBy("path").orderBy("start")  # ranges of one file: one row for each of Spark's splits
    turns = (F.col("from_out") & ~F.col("from_in")).cast("long")
    so_far = F.sum(turns).over(order)
    settled = F.when(F.col("from_out") == F.col("from_in"), F.pmod(F.col("from_out").cast("long") + so_far, F.lit(2)))
    base = F.coalesce(F.last(settled, ignorenulls=True).over(order), F.lit(0))
    ended = scanned.withColumn("ends_inside", F.pmod(base + so_far, F.lit(2)) == 1)
    begins = F.coalesce(F.lag("ends_inside").over(order), F.lit(False))
    return ended.select("path", "start", begins.alias("begins_inside"))


def read_quoted(
    spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", missing: tuple[str, ...] = MISSING, state_bytes: int = STATE_BYTES
) -> DataFrame:
    """Rows of delimited files with the given names and types; the records are stored once, in the shared folder."""
    kind: StructType = _parse_datatype_string(schema)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    )
    states = cut_lineage(range_states(lines, sep))
    size = states.agg(F.coalesce(F.sum(F.length("path") + 16), F.lit(0))).first()[0]
    if size <= state_bytes:  # a row for each split: lines keep their order
        told = lines.join(F.broadcast(states), ["path", "start"], "left")
    else:
        told = lines.withColumn("n", F.monotonically_increasing_id()).join(states, ["path", "start"], "left").sortWithinPartitions("path", "start", "n")
    # Both scans must have split the files alike.
    known = F.coalesce("begins_inside", F.raise_error(F.lit("files changed, or were split otherwise, between two scans")).cast("boolean"))
    cut = told.select("value", "path", "start", known.alias("begins_inside")).mapInArrow(
        partial(_cut, sep=sep, width=len(kind)), "kind int, path string, start long, piece string, fields array<string>"
    )
    cut = cut_lineage(cut)
    # A record across ranges: the tail of one, whole ranges, the head of another.
    order = W.partitionBy("path").orderBy("start", "kind")
    pieces = cut.where(F.col("kind") != RECORD).withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    whole = pieces.groupBy("path", "chain").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "piece"))).alias("p"))
    whole = whole.select("path", F.col("p")[0]["start"].alias("start"), F.array_join("p.piece", "\n").alias("text"))
    firsts = cut.where((F.col("kind") == RECORD) & F.col("path").isNotNull()).select("path", "start", "fields")
    # The header is the first record of its file: one that ends in the range comes before one that leaves it.
    place = lambda df, crosses: df.select("path", F.struct("start", F.lit(crosses).alias("crosses")).alias("place"))
    header = place(firsts, False).union(place(whole, True)).groupBy("path").agg(F.min("place").alias("header"))
    header = cut_lineage(header)
    kept = firsts.join(header, "path").where((F.col("start") != F.col("header.start")) | F.col("header.crosses")).select("fields")
    crossed = whole.join(header, "path").select("text", ((F.col("start") == F.col("header.start")) & F.col("header.crosses")).alias("is_header"))
    crossed = crossed.mapInArrow(partial(_parse, sep=sep, width=len(kind)), "fields array<string>")
    rest = cut.where((F.col("kind") == RECORD) & F.col("path").isNull()).select("fields")
    value = lambda i: F.when(~F.get("fields", F.lit(i)).isin(*missing), F.get("fields", F.lit(i)))
    named = ((f, value(i)) for i, f in enumerate(kind.fields))
    return rest.union(kept).union(crossed).select(
        *((v if f.dataType == StringType() else F.trim(v).try_cast(f.dataType)).alias(f.name) for f, v in named)
    )
