"""Shifts, rolling sums, market models, event windows, calendars and date lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as dt
from tidemark.operators import asof, event_panel as ep, event_study as es, joins, prices, rolling
from tidemark.operators.labels import PRODUCTS, one_hot
from tidemark.plans import study
from tidemark.plans.registry import query
from tidemark.plans.sql_views import Z95, event_rows


def rounded(df, digits=6, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("returns_shift", """
    with r as (select symbol, date, ("close"-"open")/nullif("open",0) returns from bars)
    select symbol, date, returns, lead(returns) over (partition by symbol order by date) returns_yesterday,
     lag(returns) over (partition by symbol order by date) returns_before from r""")
def returns_shift(t):
    rows = prices.with_returns(t.bars).select("symbol", "date", "returns")
    rows = prices.shifted(rows, "returns", "returns_yesterday", ["symbol"])
    return prices.shifted(rows, "returns", "returns_before", ["symbol"], direction="lag")


@query("vix_pct_change", """
    select date, vix_close, round(vix_close / lag(vix_close) over (order by date) - 1, 9) vix_return from vix""")
def vix_pct_change(t):
    return rounded(prices.percent_change(t.vix, "vix_close", "vix_return"), 9, "vix_return")


SHORT = [("positive_label_1", "pl1"), ("negative_label_1", "nl1"), ("positive_label_0", "pl0"), ("negative_label_0", "nl0"),
         ("rel_pos_label_1", "rpl1"), ("rel_neg_label_1", "rnl1"), ("rel_pos_label_0", "rpl0"), ("rel_neg_label_0", "rnl0")]


def rolled_sql(part, order, lags=(20, 40, 60, 120), columns=SHORT):
    out = []
    for n in lags:
        for c, p in columns:
            over = f"over (partition by {part} order by {order} rows between {n - 1} preceding and current row)"
            out.append(f"case when count({c}) {over} = {n} then cast(sum({c}) {over} as bigint) end {p}_{n}")
    return ",\n".join(out)


JOINED = "j as (select b.*, d.* exclude (company, date) from bars b left join daily_news d on b.symbol = d.company and b.date = d.date)"
FILLED = ("f as (select symbol, date, " + ", ".join(f"coalesce({c}, 0) {c}" for c, _ in SHORT) + " from j)")


@query("rolling_sentiment", f"""
    with {JOINED} select symbol, date, {rolled_sql("symbol", "date", (2, 3, 20, 40, 60, 120))} from j""")
def rolling_sentiment(t):
    rows = joins.stock_with_news(t.bars, study.daily_news(t)).select("symbol", "date", *PRODUCTS)
    return ep.rolling_sentiment(rows, lags=[2, 3, *ep.LAGS]).drop(*PRODUCTS)


@query("rolling_sentiment_filled", f"""
    with {JOINED}, {FILLED} select symbol, date, {rolled_sql("symbol", "date")} from f""")
def rolling_sentiment_filled(t):
    rows = joins.stock_with_news(t.bars, study.daily_news(t)).select("symbol", "date", *PRODUCTS)
    return ep.rolling_sentiment(rows, fill_missing=True).drop(*PRODUCTS)


NEWS_SHORT = [("positive", "p"), ("negative", "n"), ("neutral", "u"), ("label_0", "l0"), ("label_1", "l1")]


@query("rolling_news_labels", f"""
    select news_id, published, company,
     {rolled_sql("company", "published, news_id, title, finbert, fakebert", columns=NEWS_SHORT)} from onehot""")
def rolling_news_labels(t):
    from tidemark.operators.ranking import ranked

    order = ["published", "news_id", "title", "finbert", "fakebert"]
    bucket = F.struct("published", F.substring("news_id", 1, 2))
    rows = ranked(one_hot(t.news), ["company"], order, bucket, "_pos")
    rows = rolling.rolling_sums(rows, ["company"], "_pos", dict(NEWS_SHORT), ep.LAGS, complete=True)
    return rows.select("news_id", "published", "company", *[f"{p}_{n}" for n in ep.LAGS for _, p in NEWS_SHORT])


def beta_sql(n):
    over = f"over (partition by symbol order by date rows between {n - 1} preceding and current row)"
    return f"""
        r as (select b.symbol, b.date, ("close"-"open")/nullif("open",0) returns, market_return
          from bars b left join market m on b.date = m.date),
        be as (select *, case when count(returns) {over} = {n} and count(market_return) {over} = {n}
          then covar_samp(returns, market_return) {over} / nullif(var_samp(market_return) {over}, 0) end beta from r)"""


@query("rolling_beta", f"""
    with {beta_sql(120)}, a as (select *, 100*(returns - beta*market_return) ar from be)
    select symbol, date, round(beta, 6) beta, round(ar, 6) ar,
     case when ar >= 0.2533471031357997 then 0 when ar <= -0.2533471031357997 then 1 else 2 end ar_signif from a""")
def rolling_beta(t):
    rows = prices.join_market(prices.with_returns(t.bars), study.market(t))
    return rounded(rolling.market_model(rows, 120), 6, "beta", "ar").select("symbol", "date", "beta", "ar", "ar_signif")


@query("capm_beta", f"""
    with {beta_sql(30)},
    a as (select be.*, rf, 100*(returns - (rf + beta*(market_return - rf))) ar from be join rates on be.date = rates.date)
    select symbol, date, round(beta, 6) beta, round(ar, 6) ar,
     case when ar >= {Z95} then 'Positive_relevance' when ar <= -{Z95} then 'Negative_relevance'
      else 'Not_relevant' end ar_signif from a""")
def capm_beta(t):
    rows = prices.join_market(prices.with_returns(t.bars), study.market(t))
    return rounded(rolling.capm(rows, t.rates, 30), 6, "beta", "ar").select("symbol", "date", "beta", "ar", "ar_signif")


def study_sql(*args, **kw):
    return f"""
        with {event_rows(*args, **kw)}
        select s.symbol, s.date, st.event_id, round(st.beta, 6) beta, round(st.ar, 6) ar, st.ar_signif, st.event
        from stock s left join study st on s.symbol = st.symbol and s.pos = st.pos"""


def study_columns(df):
    return rounded(df, 6, "beta", "ar").select("symbol", "date", "event_id", "beta", "ar", "ar_signif", "event")


@query("event_study", study_sql())
def event_study(t):
    return study_columns(study.study(t))


@query("event_study_pre", study_sql("pre_event"))
def event_study_pre(t):
    return study_columns(study.study(t, "pre_event"))


@query("event_overlap_resolve", study_sql("symmetric", "last", 5))
def event_overlap_resolve(t):
    return study_columns(study.study(t, keep="last", min_est_rows=5))


@query("market_adjusted_return", f"""
    with {event_rows()}
    select s.symbol, s.date, round(coalesce(st.ar, 100*(s.returns - s.market_return), 0), 6) ar
    from stock s left join study st on s.symbol = st.symbol and s.pos = st.pos""")
def market_adjusted_return(t):
    return rounded(es.market_adjusted(study.study(t)).select("symbol", "date", "ar"), 6, "ar")


HOLIDAY_SQL = """
    days as (select cast(d as date) d from (select unnest(generate_series(timestamp '1994-12-01', timestamp '2002-02-01', interval 1 day)) d) g),
    fixed(m, dom, since) as (values (1,1,0), (6,19,2021), (7,4,0), (11,11,0), (12,25,0)),
    fixed_days as (select case dayofweek(d) when 6 then d - 1 when 0 then d + 1 else d end d from days join fixed
      on month(d) = m and day(d) = dom and year(d) >= since),
    floating as (select d from days where
      (month(d) = 1 and dayofweek(d) = 1 and day(d) between 15 and 21) or
      (month(d) = 2 and dayofweek(d) = 1 and day(d) between 15 and 21) or
      (month(d) = 5 and dayofweek(d) = 1 and day(d) >= 25) or
      (month(d) = 9 and dayofweek(d) = 1 and day(d) <= 7) or
      (month(d) = 10 and dayofweek(d) = 1 and day(d) between 8 and 14) or
      (month(d) = 11 and dayofweek(d) = 4 and day(d) between 22 and 28)),
    open_days as (select d from days where dayofweek(d) not in (0, 6) and d not in (select d from fixed_days)
      and d not in (select d from floating)),
    roll as (select d.d, min(o.d) open_day from days d join open_days o on o.d between d.d and d.d + 10 group by d.d)"""


@query("business_day_roll", f"""
    with {HOLIDAY_SQL}
    select o_orderkey, cast(o_orderdate as date) date, open_day from orders join roll on cast(o_orderdate as date) = roll.d""")
def business_day_roll(t):
    rows = t.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return rows.withColumn("open_day", dt.next_open_day("date"))


@query("source_lag_search", f"""
    with {HOLIDAY_SQL},
    n as (select source, company, lag,
       cast(cast(open_day as timestamp) + (published::timestamp - date_trunc('day', published::timestamp)) - lag * interval 1 hour as date) date,
       cast(sum(positive - negative) as double) net
      from onehot join roll on cast(published as date) = roll.d cross join (values (0), (6), (12), (18)) g(lag) group by all),
    s as (select source, lag, round(abs(corr(net, ("close"-"open")/nullif("open",0))), 9) score
      from n join bars b on n.company = b.symbol and n.date = b.date group by source, lag)
    select source, lag / 24.0::double as lag_days, score from (select *, row_number() over (partition by source order by score desc nulls last, lag) rn from s) t
    where rn = 1""")
def source_lag_search(t):
    from tidemark.operators.publication_lag import best_lags

    return best_lags(one_hot(t.news), prices.with_returns(t.bars))


@query("asof_nearest", """
    select c.symbol, c.date, c.diluted_shares, round(c.diluted_shares * b."close", 3) market_cap
    from capped c join bars b on c.symbol = b.symbol and c.date = b.date""")
def asof_nearest(t):
    out = asof.market_cap(t.bars, t.shares)
    return rounded(out, 3, "market_cap").select("symbol", "date", "diluted_shares", "market_cap")
