"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import pytest

from conftest import SF
from tidemark.plans import catalogue
from tools.check import TABLES, compare, rows_of

# Each builds the event panel anew, as others here do; tools/check.py compares them too.
SLOW = {
    "event_panel_surprise", "event_panel_filled", "day_panel", "eps_sweep", "first_story", "panel_ols", "panel_ols_crossed",
    "sentiment_hypotheses", "pooled_ols",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in catalogue.SQL if n not in SLOW])
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalogue.SQL[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    problem = compare(got, want)
    assert problem is None, problem


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
