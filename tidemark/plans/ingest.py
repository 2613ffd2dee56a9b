"""Files, staged writes, searches, page links, resumable ingest, scoring and streams."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import ingest as ing, reshape, scoring
from tidemark.operators.labels import one_hot
from tidemark.plans import study
from tidemark.plans.registry import query
from tidemark.plans.scalars import STRIP
from tidemark.session import cut_lineage, letting_go, new_path, sized
from tidemark.sources import files
from tidemark.streaming import streams


@query("scan_news", """
    select title, news_id link, case when b_org = 1 then published end date, company from news""")
def scan_news(t):
    date = F.when(F.col("b_org") == 1, F.col("published").cast("string")).otherwise("no date")
    raw = t.news.select(
        F.lit(0).alias("n"), F.col("title").alias("Title"), F.col("news_id").alias("link"), date.alias("Date"),
        F.lit("").alias("Ex."), F.col("company").alias("Company"),
    )
    path = files.write_plain(raw, new_path(t.spark, "news"))
    rows = files.scan_news(t.spark, path)
    return rows.select("title", "link", F.col("date").cast("timestamp_ntz").alias("date"), F.col("company").cast("bigint").alias("company"))


SPLIT = "case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'evaluation' else 'train' end"


@query("labelled_splits", f"""
    select {SPLIT} split, {STRIP.format("concat(title, '. ', text)")} text, label from articles""")
def labelled_splits(t):
    rows = cut_lineage(t.articles.select("title", "text", "label", F.expr(SPLIT).alias("split")))
    folders = {}
    for split in ("train", "evaluation", "test"):
        part = rows.where(F.col("split") == split).select("title", "text", "label")
        folders[split] = files.write_plain(part, new_path(t.spark, f"split-{split}"), ";")
    return files.labelled_splits(t.spark, folders)


@query("labelled_union", f"""
    select {STRIP.format("title")} title, {STRIP.format("subject")} subject, label, published publish_date, year(published) publish_year,
     length({STRIP.format("text")}) chars from articles""")
def labelled_union(t):
    folders = {}
    articles = cut_lineage(t.articles)
    for label in (0, 1):
        part = articles.where(F.col("label") == label)
        part = part.select("title", "text", "subject", F.col("published").cast("string").alias("date"))
        folders[label] = files.write_plain(part, new_path(t.spark, f"articles-{label}"))
    rows = files.labelled_articles(t.spark, folders)
    return rows.select("title", "subject", "label", "publish_date", "publish_year", F.length("text").alias("chars"))


@query("stage_roundtrip", "select news_id, negative, neutral, positive, label_0, label_1 from onehot")
def stage_roundtrip(t):
    path = new_path(t.spark, "onehot")
    made = one_hot(t.news).select("news_id", "negative", "neutral", "positive", "label_0", "label_1")
    files.stage(made, path)
    # The second call finds the finished stage and does not compute it again.
    return files.stage(made, path)


KINDS = ("csv", "json", "parquet", "orc")
SINK_SCHEMA = "company bigint, date date, positive bigint, negative bigint"


@query("result_sinks", " union all ".join(
    f"select '{k}' kind, company, date, positive, negative from daily_news" for k in KINDS))
def result_sinks(t):
    daily = cut_lineage(study.daily_news(t).select("company", "date", "positive", "negative"))
    back = []
    for kind in KINDS:
        path = files.sink(daily, new_path(t.spark, f"sums-{kind}"), kind)
        back.append(files.load(t.spark, path, kind, SINK_SCHEMA).withColumn("kind", F.lit(kind)))
    return reshape.union_all(*back)


@query("ingest_unprocessed", "select news_id, company, published, title from news")
def ingest_unprocessed(t):
    """The store starts with the companies of early news; the rest is ingested."""
    rows = cut_lineage(t.news.select("news_id", "company", "published", "title"))
    done = sized(rows.where(F.col("published") < F.lit("1995-01-05").cast("timestamp_ntz")).select("company").distinct())
    store = new_path(t.spark, "store")
    with letting_go(t.spark):
        rows.join(done, "company", "left_semi").select(*rows.columns).write.parquet(store, compression="zstd")
    return ing.ingest_missing(rows, store, "company")


@query("entity_head", "select company, n from (select company, count(*) n from news group by company) t order by n desc, company limit 51")
def entity_head(t):
    counts = t.news.groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return ing.entity_head(counts, 51, F.desc("n"), "company")


TERMS = """select distinct split_part(p_name, ' ', 2) term, 'name' kind from part
    union all select distinct p_brand term, 'ticker' kind from part"""


@query("windowed_search", f"""
    with terms as ({TERMS}),
    said as (select published, ' ' || trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' s from news),
    asked as (select kind, term, ' ' || trim(regexp_replace(lower(term), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' a from terms),
    hits as (select kind, term, cast(published as date) d from said join asked on contains(s, a)),
    w as (select kind, term, d - o.i window_start from hits, (select cast(unnest(range(5)) as int) i) o)
    select kind, term, window_start, count(*) hits from w
    where window_start >= date '1996-01-01' and window_start < date '1998-09-01' group by all""")
def windowed_search(t):
    part = t.table("part")
    names = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term"), F.lit("name").alias("kind")).distinct()
    tickers = part.select(F.col("p_brand").alias("term"), F.lit("ticker").alias("kind")).distinct()
    hits = ing.windowed_search(t.news.select("title", "published"), names.union(tickers), "1996-01-01", "1998-09-01")
    return hits.groupBy("kind", "term", "window_start").agg(F.count(F.lit(1)).alias("hits"))


@query("page_links", rf"""
    with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) publisher,
      unnest(regexp_extract_all(html, '{ing.LIST_LINK}', 1)) link, unnest(regexp_extract_all(html, '{ing.LIST_LINK}', 2)) title,
      unnest(range(len(regexp_extract_all(html, '{ing.LIST_LINK}', 1)))) place from pages)
    select page_id, cast(place as int) place, link, title, publisher from p""")
def page_links(t):
    return ing.page_links(t.table("pages"))


# -- scoring ------------------------------------------------------------------
# A hand-made lexicon and gazetteer over the words the given texts use.

POSITIVE = ["the", "for", "with", "la", "der", "el"]
NEGATIVE = ["this", "that", "was", "les", "und", "los"]
GAZETTEER = {"B-ORG": ["Is", "The", "La", "Der"], "B-LOC": ["On", "To", "En", "Und"], "B-PER": ["And", "Of", "El", "Die"]}


def in_list(names):
    return ", ".join(f"'{n}'" for n in names)


SCORE_SQL = f"""
    with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') ws from documents),
    h as (select doc_id, len(list_filter(ws, lambda x: x in ({in_list(POSITIVE)}))) p, len(list_filter(ws, lambda x: x in ({in_list(NEGATIVE)}))) n from w)
    select doc_id, case when p > n then 'positive' when p < n then 'negative' else 'neutral' end label,
     coalesce(cast(abs(p - n) as double) / nullif(p + n, 0), 0) score from h"""


@query("batch_text_score", SCORE_SQL)
def batch_text_score(t):
    return scoring.lexicon_score(t.table("documents"), "text", POSITIVE, NEGATIVE).select("doc_id", "label", "score")


def load_lexicon():
    """The word-list scorer as a plugged-in model, for Arrow batches."""
    word = re.compile(r"\w\w+")
    pos, neg = set(POSITIVE), set(NEGATIVE)

    def score(texts: pd.Series):
        found = texts.str.lower().map(word.findall)
        p = found.map(lambda ws: sum(w in pos for w in ws))
        n = found.map(lambda ws: sum(w in neg for w in ws))
        label = (p > n).map({True: "positive", False: "neutral"}).where(p >= n, "negative")
        return label, ((p - n).abs() / (p + n)).fillna(0.0)

    return score


@query("batch_text_score_model", SCORE_SQL)
def batch_text_score_model(t):
    return scoring.model_score(t.table("documents").select("doc_id", "text"), "text", load_lexicon).drop("text")


@query("entity_tags", f"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') ws from documents)
    select doc_id, {", ".join(f'''nullif(array_to_string(list_filter(ws, lambda x: x in ({in_list(n)})), ' '), '') "{k.replace('-', '_').lower()}"''' for k, n in GAZETTEER.items())} from w""")
def entity_tags(t):
    tagged = t.table("documents").select("doc_id", scoring.entity_tags("text", GAZETTEER).alias("tags"))
    return tagged.select("doc_id", *[
        F.array_join(F.col("tags")[tag], " ").alias(tag.replace("-", "_").lower()) for tag in GAZETTEER
    ])


# -- streams ------------------------------------------------------------------


def event_stream(t):
    rows = streams.read_table(t.spark, f"{t.folder}/events.parquet", t.table("events").schema)
    kind = F.col("event_type")
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.when(kind == "purchase", 1).otherwise(0).alias("positive"),
        F.when(kind == "error", 1).otherwise(0).alias("negative"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query("stream_ingest", """
    select event_id, ts, user_id, event_type, cast(json_extract_string(props, '$.k') as int) k from events""")
def stream_ingest(t):
    path = new_path(t.spark, "ingested")
    streams.ingest(event_stream(t), path, new_path(t.spark, "ingest-state")).awaitTermination()
    rows = t.spark.read.parquet(path)
    return rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "k")


@query("stream_first_story", """
    select user_id, event_type, min(ts) first_ts from events group by all""")
def stream_first_story(t):
    path = new_path(t.spark, "first-seen")
    rows = event_stream(t).select("user_id", "event_type", "ts", "event_id")
    streams.first_seen(rows, ["user_id", "event_type"], ["ts", "event_id"], path, new_path(t.spark, "first-seen-state")).awaitTermination()
    return t.spark.read.parquet(path).select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("first_ts"))


@query("stream_daily_sums", """
    select user_id, cast(ts as date) date, cast(sum(cast(event_type = 'purchase' as int)) as bigint) positive,
     cast(sum(cast(event_type = 'error' as int)) as bigint) negative
    from events group by all""")
def stream_daily_sums(t):
    path, columns = new_path(t.spark, "daily-sums"), ["positive", "negative"]
    streams.daily_sums(event_stream(t), "user_id", "ts", columns, path, new_path(t.spark, "daily-sums-state")).awaitTermination()
    return streams.totals(t.spark, path, "user_id", columns)
