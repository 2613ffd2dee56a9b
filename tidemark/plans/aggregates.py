"""Grouped sums, frequency tables and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg, clean, joins, labels, prices
from tidemark.plans.registry import query


def dates_of(news):
    return news.withColumn("date", F.to_date("published"))


@query("daily_news_sums", "select * from daily_news")
def daily_news_sums(t):
    return agg.daily_news_sums(t.news, t.sources_class)


@query("daily_news_ratios", "select * from ratios")
def daily_news_ratios(t):
    return agg.daily_news_ratios(t.news)


UNCERT = """
    select date, greatest(0, coalesce(1 - cast(sum(negative) as double) / nullif(sum(positive) + sum(negative), 0), 0)) uncert
    from daily_news group by date"""


@query("daily_uncertainty", UNCERT)
def daily_uncertainty(t):
    return agg.daily_uncertainty(agg.daily_news_sums(t.news, t.sources_class))


MEANS = """
    m as (select symbol, avg(abs(("close"-"open")/nullif("open",0)) / nullif(high*high*volume/2, 0)) illiquidity
      from bars group by symbol)"""


@query("illiquid_flag", f"""
    with {MEANS} select symbol, round(illiquidity * 1e12, 6) illiquidity_e12,
     case when illiquidity >= (select quantile_cont(illiquidity, 0.75) from m) then 1 else 0 end illiq from m""")
def illiquid_flag(t):
    flags = agg.illiquid_flags(prices.with_illiquidity(prices.with_returns(t.bars)))
    return flags.select("symbol", F.round(F.col("illiquidity") * F.lit(1e12), 6).alias("illiquidity_e12"), "illiq")


@query("publication_counts", "select company, count(*) n from news group by company")
def publication_counts(t):
    return agg.frequencies(t.news, "company")


@query("distinct_entities", "select distinct company from news")
def distinct_entities(t):
    return agg.distinct_values(t.news, "company")


VOLUMES = ["negative", "neutral", "positive", "label_0", "label_1"]
SUMS = ", ".join(f"cast(sum({c}) as bigint) {c}" for c in VOLUMES)


@query("daily_label_volume", f"select date, {SUMS} from onehot group by date")
def daily_label_volume(t):
    return agg.totals(dates_of(labels.one_hot(t.news)), ["date"], VOLUMES)


@query("source_type_totals", f"""
    select case when relevant > 0 then 1 when traditional > 0 then 2 else 0 end source_type, company, {SUMS}
    from onehot left join sources_class using (source) group by rollup(source_type, company)""")
def source_type_totals(t):
    typed = joins.with_source_class(labels.one_hot(t.news), t.sources_class)
    return agg.rolled_totals(typed.withColumn("source_type", clean.source_type()), ["source_type", "company"], VOLUMES)


DESCRIBED = ["returns", "volume", "high", "dividends"]


@query("describe_panel", """
    with r as (select *, ("close"-"open")/nullif("open",0) returns from bars),
    u as (select 'returns' as "column", returns v from r union all select 'volume', volume from r
      union all select 'high', high from r union all select 'dividends', dividends from r)
    select "column", count(v) "count", round(avg(v), 6) mean, round(stddev_samp(v), 6) std, min(v) "min", max(v) "max",
     round(quantile_cont(v, 0.25), 6) q25, round(quantile_cont(v, 0.5), 6) q50, round(quantile_cont(v, 0.75), 6) q75
    from u where v is not null group by 1""")
def describe_panel(t):
    out = agg.describe(prices.with_returns(t.bars), DESCRIBED)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query("describe_by_company", """
    select symbol, 'volume' as "column", count(volume) "count", round(avg(volume), 6) mean,
     round(stddev_samp(volume), 6) std, min(cast(volume as double)) "min", max(cast(volume as double)) "max",
     quantile_cont(cast(volume as double), 0.25) q25, quantile_cont(cast(volume as double), 0.5) q50,
     quantile_cont(cast(volume as double), 0.75) q75
    from bars group by symbol""")
def describe_by_company(t):
    out = agg.describe(t.bars, ["volume"], ["symbol"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("label_crosstab", """
    select finbert, cast(sum(label_0) as bigint) "fakebert_LABEL_0", cast(sum(label_1) as bigint) "fakebert_LABEL_1"
    from onehot group by finbert""")
def label_crosstab(t):
    return agg.crosstab(t.news, "finbert", "fakebert", ["LABEL_0", "LABEL_1"])


@query("daily_title_concat", """
    select company, cast(published as date) date, string_agg(title, '' order by published nulls first, news_id nulls first, title) text
    from news group by all""")
def daily_title_concat(t):
    return agg.title_texts(t.news)



@query("binary_metrics", """
    with p as (select quality y, 1 - toxic p from labels),
    c as (select count(*) n, sum(y*p) tp, sum((1-y)*p) fp, sum(y*(1-p)) fn, sum(cast(y = p as int)) same from p)
    select round(same/n, 9) accuracy, round(coalesce(tp/nullif(tp+fp,0),0), 9) "precision",
     round(coalesce(tp/nullif(tp+fn,0),0), 9) recall, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0), 9) f1 from c""")
def binary_metrics(t):
    rows = t.table("labels").withColumn("prediction", 1 - F.col("toxic"))
    out = agg.binary_metrics(rows, "quality", "prediction")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("weighted_f1", """
    with p as (select finbert y, case when o.s = 'F' then 'positive' when o.s = 'P' then 'negative' else 'neutral' end p
      from (select finbert, case fakebert when 'LABEL_0' then 'F' else case when b_org = 1 then 'P' else 'O' end end s from news) o),
    cls as (select distinct y c from p union select distinct p from p),
    m as (select c, (select count(*) from p where y = c) t, (select count(*) from p where p.p = c) s,
       (select count(*) from p where y = c and p.p = c) h from cls)
    select round(sum(coalesce(2*h/nullif(t+s,0),0) * t) / sum(t), 9) weighted_f1 from m""")
def weighted_f1(t):
    guess = (
        F.when(F.col("fakebert") == "LABEL_0", "positive").when(F.col("b_org") == 1, "negative").otherwise("neutral")
    )
    out = agg.weighted_f1(t.news.withColumn("guess", guess), "finbert", "guess")
    return out.select(F.round("weighted_f1", 9).alias("weighted_f1"))


@query("auc_gini", """
    with p as (select quality y, n_chars s from documents d join labels l on d.doc_id = l.doc_id),
    g as (select s, sum(y) pos, sum(1-y) neg from p group by s),
    w as (select sum(pos * (coalesce(b, 0) + neg/2)) wins, sum(pos) tp, sum(neg) tn from (
      select *, sum(neg) over (order by s rows between unbounded preceding and 1 preceding) b from g) t)
    select round(wins / (tp * tn), 9) auc, round(2 * (wins / (tp * tn)) - 1, 9) gini from w""")
def auc_gini(t):
    rows = t.table("documents").select("doc_id", "n_chars").join(t.table("labels"), "doc_id")
    out = agg.auc_gini(rows, "quality", "n_chars")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("dedup_news", "select distinct company, source, title, body from stories")
def dedup_news(t):
    return clean.drop_repeats(t.stories, ["company", "source", "title", "body"])


def market_classes(t):
    """Price rows with the class of their market-adjusted return."""
    from tidemark.functions import finance as fin

    rows = prices.join_market(prices.with_returns(t.bars), prices.market_series(t.index_bars, t.vix))
    stat = F.lit(100) * (F.col("returns") - F.col("market_return"))
    return rows.withColumn("ar_signif", fin.significance(stat))


@query("significance_counts", """
    with a as (select 100*(("close"-"open")/nullif("open",0) - market_return) s
      from bars b left join market m on b.date = m.date)
    select case when s >= 1.6448536269514722 then 1 when s <= -1.6448536269514722 then 2 else 0 end ar_signif,
     count(*) n from a group by 1""")
def significance_counts(t):
    return agg.frequencies(market_classes(t), "ar_signif")
