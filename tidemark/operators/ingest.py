"""Search hits, page links, entity picks and resumable ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import letting_go, sized

# Fixed value: a list item that opens with a link; groups are address and text.
LIST_LINK = r'<li[^>]*>\s*<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per linked list item of a page: place, address, title, publisher.

    The publisher is the host of the page.
    """
    group = lambda k: F.regexp_extract_all(F.col(html), F.lit(LIST_LINK), F.lit(k))
    items = F.arrays_zip(group(1).alias("link"), group(2).alias("title"))
    host = F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1)
    rows = pages.select("page_id", host.alias("publisher"), F.posexplode(items).alias("place", "item"))
    return rows.select("page_id", "place", F.col("item.link").alias("link"), F.col("item.title").alias("title"), "publisher")


def windowed_search(
    news: DataFrame, terms: DataFrame, start: str, end: str, days: int = 5, title: str = "title", published: str = "published"
) -> DataFrame:
    """Search hits in overlapping windows of `days` days, one starting each day.

    A hit is a title that holds the words of the term one after the other,
    whatever signs stand around them. Titles list their runs of as many words
    as terms have, so that terms meet titles by equal keys and not one by one;
    a hit lists its own windows in the same way. A term searched under two
    kinds gives two hits; a term without words gives none.
    """
    keyed = terms.withColumn("_words", _words("term")).where(F.size("_words") > 0)
    lengths = sorted(r[0] for r in keyed.select(F.size("_words")).distinct().collect())
    runs = F.flatten(F.array(*[_runs("_title", n) for n in lengths])) if lengths else F.array().cast("array<string>")
    rows = news.withColumn("_title", _words(title)).select("*", F.explode(F.array_distinct(runs)).alias("_run")).drop("_title")
    keyed = keyed.withColumn("_run", F.array_join("_words", " ")).drop("_words")
    hits = rows.join(keyed, "_run").drop("_run")
    day = F.to_date(published)
    first = F.greatest(F.date_sub(day, days - 1), F.lit(start).cast("date"))
    last = F.least(day, F.date_sub(F.lit(end).cast("date"), 1))
    windows = F.when(first <= last, F.sequence(first, last))
    return hits.withColumn("window_start", F.explode(windows))


def _words(column: str) -> Column:
    """Words in lower case: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _runs(words: str, n: int) -> Column:
    """All runs of n words, joined by spaces."""
    last = F.size(words) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))


def entity_head(entities: DataFrame, n: int, *order) -> DataFrame:
    """The first n entities in a stated order."""
    return entities.orderBy(*order).limit(n)


def unprocessed(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows of entities that were not ingested before; their keys are stored, so that few of them are sent to the rows."""
    return rows.join(sized(processed.select(key).distinct()), key, "left_anti")


def ingest_missing(rows: DataFrame, store: str, key: str) -> DataFrame:
    """Append to the store what its entities lack, and return the whole store.

    What is already there is read from the store itself, so a run that stops
    half way is resumed by running it again.
    """
    spark = rows.sparkSession
    have = spark.read.schema(rows.schema).parquet(store)
    missing = unprocessed(rows, have, key)
    with letting_go(spark):
        missing.write.mode("append").parquet(store, compression="zstd")
    return spark.read.schema(rows.schema).parquet(store)
