"""Top-k, samples, splits, folds, date lists, unions and reshaping."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemark.functions.columns import sum0
from tidemark.operators import folds, labels, prices, ranking, reference_dates as ref, reshape
from tidemark.operators.aggregates import totals
from tidemark.plans import study
from tidemark.plans.registry import query
from tidemark.plans.sql_views import event_rows

VOLUMES = ["negative", "neutral", "positive", "label_0", "label_1"]

# Rows of events inside the range, one per (symbol, event), dated by the first day.
EVENTS_SQL = f"""{event_rows()},
    e as (select s.symbol, case when st.event = 1 then st.event_id end event_only_index, s.date, s.surprise_percent
      from stock s join study st on s.symbol = st.symbol and s.pos = st.pos
      where s.date between date '{study.START}' and date '{study.END}'),
    ep as (select symbol, event_only_index, min(date) date, round(coalesce(sum(surprise_percent), 0), 6) + 0 surprise_percent
      from e where event_only_index is not null group by symbol, event_only_index)"""


def events(t):
    """(symbol, event) rows with their first day and summed surprise."""
    from tidemark.operators.event_study import event_only_index

    rows = event_only_index(study.study(t)).where(F.col("event_only_index").isNotNull())
    rows = rows.where(F.col("date").between(F.lit(study.START).cast("date"), F.lit(study.END).cast("date")))
    return rows.groupBy("symbol", "event_only_index").agg(
        F.min("date").alias("date"), F.round(sum0("surprise_percent"), 6).alias("surprise_percent")
    )


@query("panel_latest_n", f"""
    with {EVENTS_SQL}, l as (select * from ep order by date desc, symbol desc, event_only_index desc limit 343)
    select *, min(date) over () cut_date from l""")
def panel_latest_n(t):
    last = ranking.latest(events(t), 343, F.desc("date"), F.desc("symbol"), F.desc("event_only_index"))
    return last.withColumn("cut_date", F.min("date").over(W.partitionBy(F.lit(0))))


@query("topk_subjects", """
    with c as (select label, subject, count(*) n from articles group by all having count(*) >= 2)
    select label, subject, n, rank from (select *, cast(row_number() over (partition by label order by n desc, subject) as int) rank from c) t
    where rank <= 2""")
def topk_subjects(t):
    return folds.top_subjects(t.articles, k=2, min_rows=2)


@query("tail2_illiquidity", """
    with r as (select symbol, date, abs(("close"-"open")/nullif("open",0)) / nullif(high*high*volume/2, 0) v,
      row_number() over (partition by symbol order by date desc) rn from bars)
    select symbol, round(1e12 * sum(v), 6) illiquidity_e12 from r where rn <= 2 group by symbol""")
def tail2_illiquidity(t):
    rows = prices.with_illiquidity(prices.with_returns(t.bars)).select("symbol", "date", "illiquidity")
    last = ranking.top_k(rows, ["symbol"], [F.desc("date")], 2)
    return last.groupBy("symbol").agg(F.round(F.lit(1e12) * F.sum("illiquidity"), 6).alias("illiquidity_e12"))


@query("balanced_sample", """
    with r as (select doc_id, label, row_number() over (partition by label order by md5(cast(doc_id as varchar)), doc_id) rn from articles),
    m as (select min(n) n from (select count(*) n from articles group by label) t)
    select doc_id, label from r where rn <= (select n from m)""")
def balanced_sample(t):
    return ranking.balanced_sample(t.articles.select("doc_id", "label"), "label", "doc_id")


@query("stratified_split", """
    with r as (select doc_id, label, row_number() over (partition by label order by md5(cast(doc_id as varchar)), doc_id) rn,
      count(*) over (partition by label) n from articles)
    select doc_id, label, case when rn <= ceil(n * 0.1::double) then 'test' else 'train' end split from r""")
def stratified_split(t):
    return ranking.split(t.articles.select("doc_id", "label"), "doc_id", 0.1, "label")


@query("random_split", """
    with r as (select o_orderkey, row_number() over (order by md5(cast(o_orderkey as varchar)), o_orderkey) rn, count(*) over () n from orders)
    select o_orderkey, case when rn <= ceil(n * 0.33::double) then 'test' else 'train' end split from r""")
def random_split(t):
    return ranking.split(t.table("orders").select("o_orderkey"), "o_orderkey", 0.33)


@query("time_folds", """
    with y as (select year(published) test_year, count(*) test_rows from articles group by 1),
    c as (select *, cast(coalesce(sum(test_rows) over (order by test_year rows between unbounded preceding and 1 preceding), 0) as bigint) train_rows from y)
    select test_year, test_rows, train_rows, cast(row_number() over (order by test_year) as int) fold from c
    where train_rows >= 10 and test_rows >= 5""")
def time_folds(t):
    return folds.time_folds(t.articles, min_train=10, min_test=5, max_folds=None)


@query("kfold_assign", """
    select doc_id, label, cast((row_number() over (partition by label order by md5(cast(doc_id as varchar)), doc_id) - 1) % 5 as int) fold
    from articles""")
def kfold_assign(t):
    return ranking.folds(t.articles.select("doc_id", "label"), "doc_id", "label", 5)


@query("domain_pairs", """
    with c as (select label, subject, count(*) n from articles group by all having count(*) >= 2),
    k as (select *, row_number() over (partition by label order by n desc, subject) rank from c qualify rank <= 2),
    d as (select a.subject true_subject, b.subject fake_subject, (a.rank - 1) * 2 + b.rank as "domain" from k a join k b on a.label = 1 and b.label = 0),
    g as (select d.*, (select count(*) from articles where subject in (d.true_subject, d.fake_subject)) n from d),
    ok as (select *, concat(true_subject, ' vs ', fake_subject) name from g where n >= 4)
    select cast(x."domain" as int) train_no, cast(y."domain" as int) test_no, x.name train_domain, y.name test_domain
    from ok x join ok y on x."domain" <> y."domain" order by 1, 2 limit 4""")
def domain_pairs(t):
    return folds.domain_pairs(t.articles, k=2, min_rows=2, max_pairs=4).drop("train_subjects", "test_subjects")


# -- reference dates ----------------------------------------------------------
# The list: every release date, one symbol's after another's. The panel: events of the
# study range, so some dates find no event.

LIST_SQL = """
    l as (select row_number() over (order by symbol, date) pos, date from releases),
    b as (select *, case when date < lag(date) over (order by pos) then 1 else 0 end br from l),
    g as (select pos, date, 1 + cast(sum(br) over (order by pos) as bigint) group_no from b),
    groups as (select *, pos - min(pos) over (partition by group_no) + 1 in_group from g)"""
NUMBERED_SQL = """
    tick as (select symbol, row_number() over (order by symbol) group_no from (select distinct symbol from ep) t),
    num as (select ep.*, group_no, row_number() over (partition by ep.symbol order by event_only_index) in_group
      from ep join tick on ep.symbol = tick.symbol)"""


def listed(t):
    releases = t.with_stored_bars().releases  # the events start from the same bars
    return ref.date_groups(ref.listing(releases.select("symbol", "date"), "symbol", "date"), chunk=1000)


@query("descending_break_groups", f"with {LIST_SQL} select * from groups")
def descending_break_groups(t):
    return listed(t)


@query("assign_reference_dates", f"""
    with {EVENTS_SQL}, {LIST_SQL}, {NUMBERED_SQL}
    select num.symbol, num.event_only_index, groups.date, num.surprise_percent
    from num join groups on num.group_no = groups.group_no and num.in_group = groups.in_group""")
def assign_reference_dates(t):
    return ref.assign_dates(events(t), listed(t))


@query("unassigned_dates", f"""
    with {EVENTS_SQL}, {LIST_SQL}, {NUMBERED_SQL}
    select groups.* from groups anti join num using (group_no, in_group)""")
def unassigned_dates(t):
    return ref.unassigned(events(t), listed(t))


# One group after another: the first ticker after the last one that has a date of the group.
CHAIN_SQL = """
    met as (select distinct group_of.group_no g, num.group_no t from num join groups group_of on group_of.date = num.date),
    chain(g, t) as (
      select g, min(t) from met where g = 1 group by g
      union all select met.g, min(met.t) from chain join met on met.g = chain.g + 1 and met.t > chain.t group by met.g)"""


@query("flag_reference_dates", f"""
    with recursive {EVENTS_SQL}, {LIST_SQL}, {NUMBERED_SQL}, {CHAIN_SQL}
    select num.symbol, num.event_only_index, num.date, num.surprise_percent,
     exists (select 1 from groups join chain on g = groups.group_no where t = num.group_no and groups.date = num.date) orig_date from num""")
def flag_reference_dates(t):
    return ref.flag_dates(events(t), listed(t))


# -- unions and reshaping -----------------------------------------------------


@query("union_frames", """
    select symbol, date, "close", null::double vix_close from bars union all select null, date, "close", null from index_bars
    union all select null, date, null, vix_close from vix""")
def union_frames(t):
    return reshape.union_all(
        t.bars.select("symbol", "date", "close"), t.index_bars.select("date", "close"), t.vix.select("date", "vix_close")
    ).select("symbol", "date", "close", "vix_close")


@query("label_unpivot", """
    with d as (select date, cast(sum(negative) as bigint) negative, cast(sum(neutral) as bigint) neutral,
      cast(sum(positive) as bigint) positive, cast(sum(label_0) as bigint) label_0, cast(sum(label_1) as bigint) label_1
      from onehot group by date)
    select date, series, "value" from d unpivot ("value" for series in (negative, neutral, positive, label_0, label_1))""")
def label_unpivot(t):
    daily = totals(labels.one_hot(t.news).withColumn("date", F.to_date("published")), ["date"], VOLUMES)
    return reshape.to_long(daily, ["date"], VOLUMES)
