"""Readers and writers for delimited, JSON and columnar files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.text import combined, strip
from tidemark.sources.quoted import MISSING, read_quoted

NEWS_SCHEMA = "index bigint, title string, link string, date string, ex string, company string"
ARTICLE_SCHEMA = "title string, text string, subject string, date string"
SPLIT_SCHEMA = "title string, text string, label int"

# Texts hold quotes: they are doubled, and blanks are kept.
QUOTED = {
    "quote": '"', "escape": '"', "quoteAll": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
# Line breaks are written as two characters, so that a record is a line and a file of any size can be split.
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"))
MARK = "\u0001"  # stands for a written backslash while the others are put back


def _strings(df: DataFrame, change) -> DataFrame:
    return df.withColumns({c: change(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"})


def _on_one_line(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def _as_it_was(c: Column) -> Column:
    (back, twice), *breaks = ESCAPES
    held = F.replace(c, F.lit(twice), F.lit(MARK))
    return F.replace(reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), breaks, held), F.lit(MARK), F.lit(back))


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", missing: tuple[str, ...] = MISSING) -> DataFrame:
    """Delimited files from anywhere, with a header line that the given names replace; see `quoted`."""
    return read_quoted(spark, path, schema, sep, missing)


def read_escaped(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """Files as `write_delimited` has them: every record is a line, so one scan in any number of tasks does."""
    rows = spark.read.schema(schema).options(sep=sep, header="true", enforceSchema="true", **QUOTED).csv(path)
    return _strings(rows, _as_it_was)


def write_plain(df: DataFrame, path: str, sep: str = ",") -> str:
    """Delimited files as other programs expect them: line breaks and backslashes stand in quotes as they are."""
    df.write.mode("overwrite").options(sep=sep, header="true", **QUOTED).csv(path)
    return path


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> str:
    _strings(df, _on_one_line).write.mode("overwrite").options(sep=sep, header="true", **QUOTED).csv(path)
    return path


def scan_news(spark: SparkSession, path: str) -> DataFrame:
    """Raw news: imposed names, timestamp parsed, bad ones null."""
    raw = read_delimited(spark, path, NEWS_SCHEMA)
    return raw.withColumn("date", F.try_to_timestamp("date"))


def labelled_splits(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """`;` files of several splits as one frame, title and text merged."""
    parts = [
        read_delimited(spark, path, SPLIT_SCHEMA, ";").select(
            F.lit(split).alias("split"),
            strip(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit("")))).alias("text"),
            "label",
        )
        for split, path in folders.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def labelled_articles(spark: SparkSession, folders: dict[int, str]) -> DataFrame:
    """One file set per class, the class as a constant label, strings cleaned."""
    parts = [
        read_delimited(spark, path, ARTICLE_SCHEMA).withColumn("label", F.lit(label)) for label, path in folders.items()
    ]
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.withColumns({c: strip(c) for c in ("subject", "title", "text", "date")})
    day = F.to_date(F.try_to_timestamp("date"))
    return rows.withColumns(
        {"text_combined": combined("title", "subject", "text"), "publish_date": day, "publish_year": F.year(day)}
    )


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished write lies at `path`; an unfinished one does not count."""
    fs, marker = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def file_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or of all files in a folder."""
    fs, target = _file_system(spark, path)
    return fs.getContentSummary(target).getLength()


def stage(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """The stored stage at `path`, written first if it is not there yet.

    `rows` reads only that many, as a quick look at a large stage.
    """
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return stored.limit(rows) if rows else stored


def sink(df: DataFrame, path: str, kind: str) -> str:
    """Write as csv, json, parquet or orc."""
    if kind == "csv":
        return write_delimited(df, path)
    if kind not in ("json", "parquet", "orc"):
        raise ValueError(f"unknown sink {kind}")
    df.write.mode("overwrite").format(kind).save(path)
    return path


def load(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    if kind == "csv":
        return read_escaped(spark, path, schema)
    return spark.read.schema(schema).format(kind).load(path)
