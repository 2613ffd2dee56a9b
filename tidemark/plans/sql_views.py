"""The study views in plain SQL, for checking the Spark results elsewhere.

`with_views` puts the views a statement names, and the views those name, in
front of it as common table expressions.
"""

from __future__ import annotations

import re

CLOSE = (
    "cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(100 - round(100*l_discount) as decimal(3,0))"
    " * cast(100 + round(100*l_tax) as decimal(3,0))) as double) / 10000"
)
OPEN = "cast(sum(cast(l_extendedprice as decimal(12,2))) as double)"

VIEWS: dict[str, str] = {
    "bars": f"""
        select l_suppkey symbol, cast(l_shipdate as date) date, {OPEN} "open", max(l_extendedprice) high,
         min(l_extendedprice) low, {CLOSE} "close", cast(sum(l_quantity) as bigint) volume,
         cast(sum(cast(l_discount as decimal(4,2))) as double) dividends
        from lineitem group by l_suppkey, cast(l_shipdate as date)""",
    "index_bars": f"""
        select cast(l_shipdate as date) date, cast(sum(l_quantity) as bigint) volume, {OPEN} "open", {CLOSE} "close"
        from lineitem group by cast(l_shipdate as date)""",
    "vix": """
        select date, cast(10 as double) + cast(10*count(*) as double) / cast(1 + day(date) as double) vix_close
        from bars group by date""",
    "rates": """
        select date, cast(month(date) as double) / 10000 rf from index_bars where day(date) <> 15""",
    "shares": """
        select symbol, make_date(year(date),12,31) as_of, cast(1000*sum(volume) as bigint) diluted_shares
        from bars group by symbol, year(date)""",
    "releases": """
        select symbol, date, "open"/volume eps_estimate, "close"/volume reported_eps,
         100*("close"-"open")/"open" surprise_percent
        from (select *, row_number() over (partition by symbol, year(date), quarter(date) order by date) rn
              from bars) t where rn=1""",
    "news": """
        select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date)) news_id,
         l_suppkey company, o_orderdate published, concat(p_name,' ',p_type,' - ',p_brand) title, p_brand source,
         case l_returnflag when 'R' then 'negative' when 'A' then 'positive' else 'neutral' end finbert,
         case l_linestatus when 'O' then 'LABEL_1' else 'LABEL_0' end fakebert,
         case when o_orderpriority < '4' then 1 else 0 end b_org
        from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey""",
    "sources_class": """
        select distinct p_brand source,
         case when cast(substr(p_brand,7) as int)%3=0 then 1 else 0 end relevant,
         case when cast(substr(p_brand,7) as int)%3=1 then 1 else 0 end traditional
        from part""",
    "stories": """
        select doc_id, lang company, source, concat(text,' - ',source) title, text body,
         date '2020-01-01' + cast((doc_id*7)%1300 as int) published
        from documents""",
    "articles": """
        select d.doc_id, split_part(d.text,'.',1) title, d.text, d.source subject, l.quality label,
         date '2014-01-01' + cast((d.doc_id*7)%1600 as int) published
        from documents d join labels l on d.doc_id=l.doc_id""",
    # -- steps several statements share ------------------------------------
    "onehot": """
        select *, cast(published as date) date,
         case when finbert='positive' then 1 else 0 end positive,
         case when finbert='negative' then 1 else 0 end negative,
         case when finbert='neutral' then 1 else 0 end neutral,
         case when fakebert='LABEL_0' then 1 else 0 end label_0,
         case when fakebert='LABEL_1' then 1 else 0 end label_1
        from news""",
    "daily_news": """
        select company, date, cast(sum(positive) as bigint) positive, cast(sum(negative) as bigint) negative,
         cast(sum(positive*label_1) as bigint) positive_label_1, cast(sum(negative*label_1) as bigint) negative_label_1,
         cast(sum(positive*label_0) as bigint) positive_label_0, cast(sum(negative*label_0) as bigint) negative_label_0,
         cast(sum(positive*label_1) as bigint) rel_pos_label_1, cast(sum(negative*label_1) as bigint) rel_neg_label_1,
         cast(sum(positive*label_0) as bigint) rel_pos_label_0, cast(sum(negative*label_0) as bigint) rel_neg_label_0
        from onehot join sources_class using (source)
        where b_org = 1 and (relevant > 0 or traditional > 0)
        group by company, date""",
    "daily_all": """
        select company, date, cast(sum(positive) as bigint) positive, cast(sum(negative) as bigint) negative,
         cast(sum(neutral) as bigint) neutral, cast(sum(label_0) as bigint) label_0, cast(sum(label_1) as bigint) label_1,
         cast(sum(positive*label_1) as bigint) positive_label_1, cast(sum(negative*label_1) as bigint) negative_label_1
        from onehot group by company, date""",
    "ratios": """
        select *, positive - positive_label_1 positive_label_0, negative - negative_label_1 negative_label_0,
         coalesce(cast(positive_label_1 as double) / nullif(positive+negative+neutral, 0), 0) rel_pos_label_1,
         coalesce(cast(negative_label_1 as double) / nullif(positive+negative+neutral, 0), 0) rel_neg_label_1,
         coalesce(cast(positive - positive_label_1 as double) / nullif(positive+negative+neutral, 0), 0) rel_pos_label_0,
         coalesce(cast(negative - negative_label_1 as double) / nullif(positive+negative+neutral, 0), 0) rel_neg_label_0
        from daily_all""",
    "market": """
        select i.date, market_return, lead(market_return) over (order by i.date) market_return_yesterday,
         vix_close, vix_return, lead(vix_return) over (order by i.date) vix_return_yesterday
        from (select date, ("close"-"open")/"open" market_return from index_bars) i
        left join (select date, vix_close, vix_close / lag(vix_close) over (order by date) - 1 vix_return
                   from vix) v on i.date = v.date""",
    "capped": """
        select symbol, date, coalesce(
           last_value(s ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row),
           first_value(s ignore nulls) over (partition by symbol order by date rows between current row and unbounded following)
         ) diluted_shares
        from (select b.symbol, b.date,
               (select arg_min(diluted_shares, abs(as_of - b.date) * 2 + (case when as_of > b.date then 1 else 0 end))
                from shares h where h.symbol = b.symbol and abs(h.as_of - b.date) <= 7) s
              from bars b) t""",
    "stock": """
        select b.*, (b."close"-b."open")/b."open" returns, m.market_return, m.market_return_yesterday,
         m.vix_close, m.vix_return, m.vix_return_yesterday, c.diluted_shares * b."close" market_cap,
         r.eps_estimate, r.reported_eps, r.surprise_percent,
         cast(row_number() over (partition by b.symbol order by b.date) as bigint) - 1 pos
        from bars b left join market m on b.date = m.date
        left join capped c on b.symbol = c.symbol and b.date = c.date
        left join releases r on b.symbol = r.symbol and b.date = r.date""",
}

Z95 = "1.6448536269514722"


def event_rows(style: str = "symmetric", keep: str = "first", min_est: int = 0) -> str:
    """Event windows written out event by event, the long way round."""
    before, after = {"symmetric": (5, 5), "pre_event": (10, 0)}[style]
    pick = {"first": "arg_min", "last": "arg_max"}[keep]
    return f"""
        ev0 as (
          select symbol, pos e, greatest(0, pos-{before}) ws from stock where surprise_percent is not null),
        lastpos as (select symbol, max(pos) mx from stock group by symbol),
        symrank as (select symbol, row_number() over (order by symbol) sr from lastpos),
        est as (
          select ev.symbol, ev.e, any_value(ev.ws) ws, least(any_value(l.mx), ev.e+{after}) we,
           greatest(0, any_value(ev.ws)-50) es, count(s.pos) n_est,
           covar_samp(s.returns, s.market_return) / nullif(var_samp(s.market_return), 0) beta
          from ev0 ev join lastpos l on l.symbol = ev.symbol
          left join stock s on s.symbol = ev.symbol and s.pos >= greatest(0, ev.ws-50) and s.pos < ev.ws
          group by ev.symbol, ev.e),
        ev as (
          select est.*, 100*sr + row_number() over (partition by est.symbol order by e) as id
          from est join symrank using (symbol) where n_est >= {min_est}),
        cells as (
          select s.symbol, s.pos, ev.e, ev.id, ev.beta, 100*(s.returns - ev.beta*s.market_return) ar,
           case when s.pos >= ev.ws then 1 end in_event
          from ev join stock s on s.symbol = ev.symbol and s.pos between ev.es and ev.we),
        study as (
          select symbol, pos, cast({pick}(id, e) as bigint) event_id,
           {pick}(beta, e) filter (beta is not null) beta,
           {pick}(ar, e) filter (ar is not null) ar,
           {pick}(case when ar >= {Z95} then 1 when ar <= -{Z95} then 2 else 0 end, e) ar_signif,
           max(in_event) event
          from cells group by symbol, pos)"""


def with_views(body: str) -> str:
    """`body` with every view it needs as a leading WITH clause."""
    own = re.match(r"\s*with\s+(recursive\s+)?", body, re.I)
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text, re.I):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} as ({VIEWS[name]})" for name in needed)
    if own:
        return f"with {own.group(1) or ''}{ctes},\n{body[own.end():]}"
    return f"with {ctes}\n{body}"
