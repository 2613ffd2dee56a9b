"""Joins of prices, news and side tables, and the panels they end in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg, clean, event_panel as ep, joins, labels, prices
from tidemark.operators.labels import PRODUCTS
from tidemark.plans import study
from tidemark.plans.registry import query
from tidemark.plans.sql_views import event_rows
from tidemark.plans.windows import SHORT, rolled_sql, rounded
from tidemark.session import cut_lineage

DAILY = ["positive", "negative", *PRODUCTS]
DAILY_LIST = ", ".join(DAILY)


@query("daily_feature_table", """
    with f as (select b.symbol, b.date, case when ("close"-"open")/nullif("open",0) > 0 then 1 else 0 end returns_binary, d.* exclude (company, date)
      from bars b join daily_all d on b.symbol = d.company and b.date = d.date),
    u as (select date, greatest(0, coalesce(1 - cast(sum(negative) as double)/nullif(sum(positive)+sum(negative),0), 0)) uncert from f group by date)
    select f.* exclude (symbol), uncert, positive_label_1*uncert positive_label_1_uncert, negative_label_1*uncert negative_label_1_uncert
    from f join u on f.date = u.date""")
def daily_feature_table(t):
    return feature_table(t)


def feature_table(t):
    """Price days with any news, day uncertainty and its products; price columns dropped."""
    rows = joins.stock_with_news(prices.with_returns(t.bars), agg.daily_label_sums(t.news), "inner")
    rows = clean.drop_columns(rows, "open", "high", "low", "close", "volume", "dividends", "stock_splits", "returns", "index", "symbol")
    rows = cut_lineage(rows)  # read twice: for the days and for the rows
    rows = joins.day_lookup(rows, agg.daily_uncertainty(rows))
    return labels.times(rows, "uncert", ["positive_label_1", "negative_label_1"])


RATIO_KEPT = ["positive_label_1", "negative_label_1", "positive_label_0", "negative_label_0",
              "rel_pos_label_1", "rel_neg_label_1", "rel_pos_label_0", "rel_neg_label_0"]


def ratio_panel(t):
    """One row per price day: abnormal return or 0, controls, and news counts and shares or 0.

    Later events overwrite earlier ones here, and an event needs five estimation rows.
    """
    rows = joins.stock_with_news(study.study(t, keep="last", min_est_rows=5), agg.daily_news_ratios(t.news))
    rows = rows.withColumn("const", F.lit(1.0))
    kept = ["ar", "const", "dividends", "volume", "market_cap", "surprise_percent", *RATIO_KEPT]
    return rows.select("symbol", "date", *kept).na.fill(0, kept)


def ratio_panel_sql():
    """The same in full precision, as the models read it."""
    made = ", ".join(f"coalesce({c}, 0)::double {c}" for c in ("ar", "dividends", "volume", "market_cap", "surprise_percent", *RATIO_KEPT))
    return f"""
        with {event_rows("symmetric", "last", 5)}
        select s.symbol, {made} from stock s left join study st on s.symbol = st.symbol and s.pos = st.pos
        left join ratios r on s.symbol = r.company and s.date = r.date"""


@query("daily_ratio_panel", f"""
    with {event_rows("symmetric", "last", 5)}
    select s.symbol, s.date, round(coalesce(st.ar, 0), 6) + 0 ar, 1.0::double const, dividends, volume, round(market_cap, 3) market_cap,
     round(coalesce(surprise_percent, 0), 6) + 0 surprise_percent, {", ".join(f"coalesce({c}, 0) {c}" for c in RATIO_KEPT)}
    from stock s left join study st on s.symbol = st.symbol and s.pos = st.pos
    left join ratios r on s.symbol = r.company and s.date = r.date""")
def daily_ratio_panel(t):
    return rounded(rounded(ratio_panel(t), 6, "ar", "surprise_percent"), 3, "market_cap")


@query("stock_news_left", """
    select b.symbol, b.date, b."close", d.* exclude (company, date)
    from bars b left join daily_news d on b.symbol = d.company and b.date = d.date""")
def stock_news_left(t):
    return joins.stock_with_news(t.bars.select("symbol", "date", "close"), study.daily_news(t))


@query("market_join", """
    select b.symbol, b.date, market_return, market_return_yesterday, vix_close, round(vix_return, 9) vix_return,
     round(vix_return_yesterday, 9) vix_return_yesterday from bars b left join market m on b.date = m.date""")
def market_join(t):
    out = prices.join_market(t.bars.select("symbol", "date"), study.market(t))
    return rounded(out, 9, "vix_return", "vix_return_yesterday")


@query("earnings_join", """
    select b.symbol, b.date, eps_estimate, reported_eps, surprise_percent
    from bars b left join releases r on b.symbol = r.symbol and b.date = r.date""")
def earnings_join(t):
    return prices.join_earnings(t.bars.select("symbol", "date"), t.releases)


@query("curated_sources", """
    select news_id, source, relevant, traditional from news join sources_class using (source)
    where relevant > 0 or traditional > 0""")
def curated_sources(t):
    return joins.curated_only(t.news.select("news_id", "source"), t.sources_class)


@query("uncertainty_lookup", """
    with u as (select date, greatest(0, coalesce(1 - cast(sum(negative) as double) / nullif(sum(positive) + sum(negative), 0), 0)) uncert
      from daily_news group by date)
    select b.symbol, b.date, uncert from bars b left join u on b.date = u.date""")
def uncertainty_lookup(t):
    return joins.day_lookup(t.bars.select("symbol", "date"), agg.daily_uncertainty(study.daily_news(t)))


@query("relevance_training_set", """
    with a as (select b.symbol, b.date, 100*(("close"-"open")/nullif("open",0) - market_return) s
      from bars b left join market m on b.date = m.date),
    l as (select symbol, date, case when s >= 1.6448536269514722 then 1 when s <= -1.6448536269514722 then 2 else 0 end label from a),
    n as (select company, cast(published as date) date, string_agg(title, '' order by published, news_id, title) text from news group by all)
    select label, text from l join n on l.symbol = n.company and l.date = n.date""")
def relevance_training_set(t):
    return training_texts(t).select("label", "text")


def training_texts(t):
    """The class of a company's day with that day's titles as one text."""
    from tidemark.plans.aggregates import market_classes

    days = market_classes(t).select("symbol", "date", F.col("ar_signif").alias("label"))
    texts = agg.title_texts(t.news).withColumnRenamed("company", "symbol")
    return days.join(texts, ["symbol", "date"])


# -- feature products ---------------------------------------------------------

STATES = """
    u as (select date, greatest(0, coalesce(1 - cast(sum(negative) as double) / nullif(sum(positive) + sum(negative), 0), 0)) uncert
      from daily_news group by date),
    m as (select symbol, avg(abs(("close"-"open")/nullif("open",0)) / nullif(high*high*volume/2, 0)) il from bars group by symbol),
    i as (select symbol, case when il >= (select quantile_cont(il, 0.75) from m) then 1 else 0 end illiq from m),
    x as (select d.*, uncert, illiq from daily_news d join u on d.date = u.date join i on d.company = i.symbol)"""


def states(t):
    """Daily news sums with the day's uncertainty and the symbol's illiquidity flag."""
    daily = study.daily_news(t)
    flags = agg.illiquid_flags(prices.with_illiquidity(prices.with_returns(t.bars))).select(
        F.col("symbol").alias("company"), "illiq"
    )
    return joins.day_lookup(daily, agg.daily_uncertainty(daily)).join(flags, "company")


@query("interaction_builder", f"""
    with {STATES} select company, date, {", ".join(f"{s}*{c} {c}_{s}" for s in ("uncert", "illiq") for c in PRODUCTS)} from x""")
def interaction_builder(t):
    rows = labels.times(labels.times(states(t), "uncert", list(PRODUCTS)), "illiq", list(PRODUCTS))
    return rows.select("company", "date", *[f"{c}_{s}" for s in ("uncert", "illiq") for c in PRODUCTS])


PAIRS = [("positive_label_1", "negative_label_1"), ("positive_label_0", "negative_label_0")]


def balance_sql(p, n):
    return f"cast({p} - {n} as double) / nullif({p} + {n}, 0)"


@query("balance_index", f"""
    select company, date, {", ".join(f"{balance_sql(p, n)} / 10 + 0 {p}_index" for p, n in PAIRS)} from daily_news""")
def balance_index(t):
    return labels.balance_indices(study.daily_news(t), PAIRS).select("company", "date", *[f"{p}_index" for p, _ in PAIRS])


TF = {"true_index": PAIRS[0], "fake_index": PAIRS[1],
      "rel_true_index": ("rel_pos_label_1", "rel_neg_label_1"), "rel_fake_index": ("rel_pos_label_0", "rel_neg_label_0")}
TF_PRODUCTS = [(s, n) for s in ("uncert", "illiq") for n in [*TF, *PRODUCTS]]


@query("true_fake_index", f"""
    with {STATES}, y as (select x.* replace (uncert/10 as uncert, illiq/10 as illiq),
      {", ".join(f"{balance_sql(p, n)} + 0 {name}" for name, (p, n) in TF.items())} from x)
    select company, date, uncert, illiq, {", ".join(TF)},
     {", ".join(f"round({s}*{n}, 9) + 0 {s}_{n}" for s, n in TF_PRODUCTS)} from y""")
def true_fake_index(t):
    out = labels.true_fake_indices(states(t))
    names = [f"{s}_{n}" for s, n in TF_PRODUCTS]
    return rounded(out, 9, *names).select("company", "date", "uncert", "illiq", *TF, *names)


# -- panels -------------------------------------------------------------------

MONEY = ["market_cap"]
INTS = ["volume", "event", "event_id", *PRODUCTS, "illiq", *ep.ROLLED_NAMES]
EPS = ["eps_estimate", "reported_eps"]
FLOATS = [c for c in ep.SUMMED if c not in INTS and c not in MONEY and c != "stock_splits"]


def featured_sql(style, filled):
    return f"""{event_rows(style)},
        j as (select s.*, st.event_id, st.beta, st.ar, st.event, case when st.event = 1 then st.event_id end event_only_index,
            d.positive, d.negative, {", ".join(f"d.{c} raw_{c}" for c, _ in SHORT)}
          from stock s left join study st on s.symbol = st.symbol and s.pos = st.pos
          left join daily_news d on s.symbol = d.company and s.date = d.date
          where s.date between date '{study.START}' and date '{study.END}'),
        k as (select j.* exclude ({", ".join(f"raw_{c}" for c, _ in SHORT)}),
            {", ".join(f"coalesce(raw_{c}, 0) {c}" if filled else f"raw_{c} {c}" for c, _ in SHORT)} from j),
        u as (select date, greatest(0, coalesce(1 - cast(sum(negative) as double) / nullif(sum(positive) + sum(negative), 0), 0)) uncert
          from k group by date),
        m as (select symbol, avg(abs(returns) / nullif(high*high*volume/2, 0)) il from k group by symbol),
        i as (select symbol, case when il >= (select quantile_cont(il, 0.75) from m) then 1 else 0 end illiq from m),
        feat as (select k.*, illiq, {rolled_sql("k.symbol", "k.date")} from k join i on k.symbol = i.symbol)"""


def derived_sql():
    out = []
    for p, n in ep.INDEX_PAIRS:
        out.append(f"round({balance_sql(p, n)} / 10, 9) + 0 {p}_index")
    for s in ("uncert", "illiq"):
        out += [f"round({s} * ({balance_sql(p, n)} / 10), 9) + 0 {p}_index_{s}" for p, n in ep.INDEX_PAIRS]
        out += [f"round(cast({s}*{c} as double), 9) + 0 {c}_{s}" for c in PRODUCTS]
    return ", ".join(out)


def summed_sql():
    out = [f"cast(coalesce(sum({c}), 0) as bigint) {c}" for c in INTS]
    out += [f"round(coalesce(sum({c}), 0), {9 if c in EPS else 6}) + 0 {c}" for c in FLOATS]
    out.append("round(coalesce(sum(market_cap), 0) / 1e6, 3) market_cap_m")
    return ", ".join(out)


def panel_sql(style="symmetric", date_of="min", filled=False):
    return f"""
        with {featured_sql(style, filled)},
        p as (select symbol, event_only_index, {date_of}(date) date, round(avg(vix_close), 6) vix_index_avg, {summed_sql()}
          from feat where event_only_index is not null group by symbol, event_only_index)
        select p.*, uncert, {derived_sql()} from p left join u on p.date = u.date"""


def panel_values_sql(style="symmetric", date_of="min", filled=False):
    """The event panel in full precision, controls in logs, as the models read it."""
    summed = dict.fromkeys([*INTS, *FLOATS, "market_cap"])
    logs = {"volume", "market_cap"}
    made = ", ".join(f"coalesce(sum({c}), 0)::double {c}" for c in summed)
    out = [f"ln(nullif({c}, 0)) {c}" if c in logs else c for c in summed]
    out += [f"{balance_sql(p, n)} / 10 {p}_index" for p, n in ep.INDEX_PAIRS]
    return f"""
        with {featured_sql(style, filled)},
        p as (select symbol, event_only_index, {date_of}(date) date, {made} from feat where event_only_index is not null group by all)
        select p.symbol, event_only_index, p.date, uncert, {", ".join(out)} from p left join u on p.date = u.date"""


def tidy(df):
    """Rounded for comparison: sums of doubles depend on the order of adding."""
    made = [f"{p}_index" for p, _ in ep.INDEX_PAIRS]
    made += [f"{n}_{s}" for s in ("uncert", "illiq") for n in made + list(PRODUCTS)]
    out = df.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in made})
    out = out.withColumn("market_cap_m", F.round(F.col("market_cap") / F.lit(1e6), 3)).drop("market_cap")
    out = out.withColumns({c: F.col(c).cast("bigint") for c in INTS})
    return rounded(rounded(out, 9, *EPS), 6, "vix_index_avg", *[c for c in FLOATS if c not in EPS])


@query("event_panel", panel_sql())
def event_panel(t):
    return tidy(study.panel(t))


@query("event_panel_surprise", panel_sql("pre_event", "max"))
def event_panel_surprise(t):
    """The pre-event form, dated by the last day of the event."""
    return tidy(study.panel(t, "pre_event", "last"))


@query("event_panel_filled", panel_sql(filled=True))
def event_panel_filled(t):
    """Days without news count as 0 in the rolling windows."""
    return tidy(study.panel(t, fill_missing=True))


DAY_INTS = [c for c in INTS if c not in ("event", "event_id")] + ["event_only_index"]


@query("day_panel", f"""
    with {featured_sql("symmetric", False)},
    p as (select symbol, feat.date, {", ".join(f"cast(coalesce(sum({c}), 0) as bigint) {c}" for c in DAY_INTS)},
      {", ".join(f"round(coalesce(sum({c}), 0), {9 if c in EPS else 6}) + 0 {c}" for c in [*FLOATS, "uncert"])}, round(coalesce(sum(vix_close), 0), 6) vix_index_avg
      from feat join u on feat.date = u.date group by symbol, feat.date)
    select * from p""")
def day_panel(t):
    out = ep.day_panel(study.featured(t))
    out = rounded(out, 9, *EPS)
    out = rounded(out, 6, *[c for c in FLOATS if c not in EPS], "uncert", "vix_index_avg").withColumns({c: F.col(c).cast("bigint") for c in DAY_INTS})
    return out.select("symbol", "date", *DAY_INTS, *FLOATS, "uncert", "vix_index_avg")


@query("event_whitelist", f"""
    with {featured_sql("symmetric", False)},
    wanted as (select symbol, event_only_index from feat where event_only_index is not null group by all)
    select symbol, date, event_only_index from ({panel_sql("pre_event", "max")}) s
    semi join wanted using (symbol, event_only_index)""")
def event_whitelist(t):
    """The events of the second stage: those of the pre-event panel that the first panel holds too."""
    rows = study.listed(study.panel(t, "pre_event", "last"), study.panel(t))
    return rows.select("symbol", "date", "event_only_index")
