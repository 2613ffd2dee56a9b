"""Filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as dt, finance as fin, text as tx
from tidemark.functions.columns import flag
from tidemark.operators import clean, labels, prices
from tidemark.plans.registry import query
from tidemark.plans.sql_views import Z95


@query("ascii_filter", """
    select doc_id, title from stories where regexp_full_match(title, '[\\x00-\\x7F]*')""")
def ascii_filter(t):
    return clean.drop_non_ascii(t.stories.select("doc_id", "title"), "title")


@query("title_source_split", """
    select doc_id, regexp_extract(title, '(?s)^(.*) - (.*)$', 1) title,
     regexp_extract(title, '(?s)^(.*) - (.*)$', 2) source from stories""")
def title_source_split(t):
    return clean.split_title_source(t.stories.select("doc_id", "title"))


@query("source_second_token", """
    select news_id, split(title, ' - ')[2] source from news""")
def source_second_token(t):
    return t.news.select("news_id", tx.second_part("title").alias("source"))


HEADLINES = "concat(p_name, ' - ', case when p_size % 2 = 0 then p_type else concat(p_type, ' county, ', substr(p_type, 1, 2)) end)"


@query("headline_regex", rf"""
    with h as (select p_partkey, {HEADLINES} row from part)
    select p_partkey, nullif(regexp_extract(row, '{tx.HEADLINE}', 1), '') title,
     nullif(regexp_extract(row, '{tx.HEADLINE}', 3), '') source,
     nullif(regexp_extract(row, '{tx.HEADLINE}', 4), '') county,
     nullif(regexp_extract(row, '{tx.HEADLINE}', 5), '') state_code from h""")
def headline_regex(t):
    rows = t.table("part").select("p_partkey", F.expr(HEADLINES).alias("row"))
    return rows.select(
        "p_partkey",
        tx.headline_group("row", 1).alias("title"),
        tx.headline_group("row", 3).alias("source"),
        tx.headline_group("row", 4).alias("county"),
        tx.headline_group("row", 5).alias("state_code"),
    )


STRIP = "trim(coalesce({}, ''), chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12))"


@query("combined_text", f"""
    with a as (
      select doc_id, {STRIP.format("case when label = 0 then ' ' else title end")} title,
       {STRIP.format("subject")} subject, {STRIP.format("text")} body from articles),
    b as (
      select doc_id, body, {STRIP.format("concat(case when title = '' then subject else title end, '. ', body)")} c from a)
    select doc_id, case when starts_with(c, '. ') then body else c end text_combined from b""")
def combined_text(t):
    # Titles of class 0 are blanked, so that the subject steps in for them.
    title = F.when(F.col("label") == 0, F.lit(" ")).otherwise(F.col("title"))
    return t.articles.select("doc_id", tx.combined(title, "subject", "text").alias("text_combined"))


RAW_DATE = """case o_orderstatus when 'P' then 'no date' when 'F' then
 concat(cast(cast(o_orderdate as date) as {s}), 'T00:00:00+02:00') else cast(cast(o_orderdate as date) as {s}) end"""


@query("coerce_dates", f"""
    with r as (select o_orderkey, {RAW_DATE.format(s="varchar")} raw from orders),
    p as (select o_orderkey, cast(case when raw like '%+02:00' then try_cast(substr(raw, 1, 19) as timestamp)
      - interval 2 hour else try_cast(raw as timestamp) end as date) date from r)
    select o_orderkey, date, year(date) as "year" from p""")
def coerce_dates(t):
    raw = t.table("orders").select("o_orderkey", F.expr(RAW_DATE.format(s="string")).alias("raw"))
    return raw.select("o_orderkey", dt.parse_date("raw").alias("date")).withColumn("year", F.year("date"))


@query("date_range_filter", """
    select symbol, date, "close" from bars where date between date '1997-01-01' and date '1999-09-01'""")
def date_range_filter(t):
    day = F.col("date")
    return t.bars.where(day.between(F.lit("1997-01-01").cast("date"), F.lit("1999-09-01").cast("date"))).select(
        "symbol", "date", "close"
    )


@query("daily_returns", """
    select symbol, date, ("close"-"open")/nullif("open",0) returns,
     case when ("close"-"open")/nullif("open",0) > 0 then 1 else 0 end returns_binary from bars""")
def daily_returns(t):
    return prices.with_returns(t.bars).select("symbol", "date", "returns", "returns_binary")


@query("amihud_rows", """
    with r as (select *, ("close"-"open")/nullif("open",0) returns from bars)
    select symbol, date, round(1e12 * (abs(returns) / nullif(high*high*volume/2, 0)), 6) illiquidity_e12 from r""")
def amihud_rows(t):
    out = prices.with_illiquidity(prices.with_returns(t.bars))
    return out.select("symbol", "date", F.round(F.lit(1e12) * F.col("illiquidity"), 6).alias("illiquidity_e12"))


@query("one_hot_fixed", """
    select news_id, negative, neutral, positive, label_0, label_1 from onehot""")
def one_hot_fixed(t):
    return labels.one_hot(t.news).select("news_id", "negative", "neutral", "positive", "label_0", "label_1")


@query("one_hot_learned", """
    select doc_id, cast(lang='de' as int) de, cast(lang='en' as int) en, cast(lang='es' as int) es,
     cast(lang='fr' as int) fr from documents""")
def one_hot_learned(t):
    return labels.one_hot_learned(t.table("documents").select("doc_id", "lang"), "lang").drop("lang")


@query("label_interactions", """
    select news_id, positive*label_1 positive_label_1, negative*label_1 negative_label_1,
     positive*label_0 positive_label_0, negative*label_0 negative_label_0,
     positive*label_1 rel_pos_label_1, negative*label_1 rel_neg_label_1,
     positive*label_0 rel_pos_label_0, negative*label_0 rel_neg_label_0 from onehot""")
def label_interactions(t):
    return labels.interactions(labels.one_hot(t.news)).select("news_id", *labels.PRODUCTS)


@query("rare_source_fold", """
    with c as (select source from stories group by source having count(*) > 50)
    select doc_id, case when source in (select source from c) then source else 'Other' end source from stories""")
def rare_source_fold(t):
    return labels.fold_rare(t.stories.select("doc_id", "source"), "source", threshold=50)


@query("source_type_map", """
    select news_id, case finbert when 'positive' then 0 when 'negative' then 1 when 'neutral' then 2 end sentiment_code,
     case when relevant > 0 then 1 when traditional > 0 then 2 else 0 end source_type
    from news left join sources_class using (source)""")
def source_type_map(t):
    from tidemark.operators.joins import with_source_class

    coded = clean.fold_labels(t.news, "finbert", {"positive": 0, "negative": 1, "neutral": 2}, "sentiment_code")
    typed = with_source_class(coded, t.sources_class).withColumn("source_type", clean.source_type())
    return typed.select("news_id", "sentiment_code", "source_type")


@query("org_filter", "select news_id, company, title from news where b_org = 1")
def org_filter(t):
    return clean.only_organisations(t.news).select("news_id", "company", "title")


@query("log_controls", """
    with l as (select b.symbol, b.date, b.volume, b."close" * s.n market_cap from bars b
      join (select symbol, arg_max(diluted_shares, as_of) n from shares group by symbol) s on b.symbol = s.symbol)
    select symbol, date, round(ln(nullif(volume,0)), 9) volume, round(ln(nullif(market_cap,0)), 9) market_cap,
     1 as const from l""")
def log_controls(t):
    capped = prices.latest_market_cap(t.bars, t.shares).select("symbol", "date", "volume", "market_cap")
    out = clean.log_controls(capped, "volume", "market_cap")
    return out.withColumns({c: F.round(c, 9) for c in ("volume", "market_cap")})


@query("sanitise_columns", """
    select symbol, date, surprise_percent, cast(eps_estimate > reported_eps as int) as beat_label_1 from releases""")
def sanitise_columns(t):
    beat = flag(F.col("eps_estimate") > F.col("reported_eps")).alias("Beat*Label_1")
    wide = t.releases.select(F.col("symbol").alias("Symbol"), F.col("date").alias("Date"),
                             F.col("surprise_percent").alias("Surprise(%)"), beat)
    return clean.clean_names(wide)


@query("market_cap_latest", """
    with s as (select symbol, arg_max(diluted_shares, as_of) n from shares group by symbol)
    select b.symbol, b.date, round(s.n * b."close", 3) market_cap from bars b join s on b.symbol = s.symbol""")
def market_cap_latest(t):
    out = prices.latest_market_cap(t.bars, t.shares)
    return out.select("symbol", "date", F.round("market_cap", 3).alias("market_cap"))


@query("drop_null_keys", """
    select b.symbol, b.date, r.surprise_percent from bars b left join releases r on b.symbol=r.symbol and b.date=r.date
    where r.surprise_percent is not null""")
def drop_null_keys(t):
    joined = prices.join_earnings(t.bars, t.releases)
    return clean.drop_missing(joined.select("symbol", "date", "surprise_percent"), "surprise_percent")


@query("ar_significance", f"""
    with a as (select b.symbol, b.date, 100*(("close"-"open")/nullif("open",0) - market_return) stat
      from bars b left join market m on b.date = m.date)
    select symbol, date,
     case when stat >= {Z95} then 1 when stat <= -{Z95} then 2 else 0 end ar_signif,
     case when stat >= 0.2533471031357997 then 0 when stat <= -0.2533471031357997 then 1 else 2 end ar_class_60,
     case when stat >= {Z95} then 'Positive_relevance' when stat <= -{Z95} then 'Negative_relevance'
      else 'Not_relevant' end ar_word from a""")
def ar_significance(t):
    joined = prices.join_market(prices.with_returns(t.bars), prices.market_series(t.index_bars, t.vix))
    stat = F.lit(100) * (F.col("returns") - F.col("market_return"))
    words = ("Positive_relevance", "Negative_relevance", "Not_relevant")
    return joined.select(
        "symbol", "date",
        fin.significance(stat).alias("ar_signif"),
        fin.significance(stat, fin.Z_60, (0, 1, 2)).alias("ar_class_60"),
        fin.significance(stat, fin.Z_95, words).alias("ar_word"),
    )
