"""Panel regressions in SQL, from the normal equations.

Products of demeaned columns are added up by entity. A Gauss-Jordan elimination
over a long table (model, row, column, value) solves all models at once; scores
by entity give the clustered covariance, and Student's t is a finite sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.operators.regression import Spec

RHS, UNIT = 1000, 2000  # column numbers of the right side and of the identity


def t_pvalue_sql(t: str, df: str) -> str:
    """Two-sided p-value of t, by the sums for even and odd degrees of freedom."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    power = f"2 * k * ln(cos({angle}))"
    even = f"sin({angle}) * list_sum(list_transform(range(({df} // 2)::BIGINT), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4) + {power})))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * list_sum(list_transform(range((({df} - 1) // 2)::BIGINT), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + {power}))))"
    return f"greatest(0, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def ols_sql(source: str, columns: dict[str, str], specs: Sequence[Spec], entity: str = "symbol", effects: bool = True) -> str:
    """Entity-effects least squares, errors clustered by entity, of `specs` over rows of `source`.

    `columns` gives each column's expression; rows that lack any are left out.
    Without `effects` the rows are pooled and errors have one variance.
    """
    over = "OVER (PARTITION BY g)" if effects else "OVER ()"
    absorbed = "entities - 1" if effects else "0"
    names = list(dict.fromkeys(c for s in specs for c in (s.target, *s.terms)))
    at = {c: i for i, c in enumerate(names)}
    k = max(len(s.terms) for s in specs)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    read = ", ".join(f"({columns.get(c, c)})::DOUBLE AS c{i}" for c, i in at.items())
    sds = ", ".join(f"stddev_samp(c{i}) AS s{i}, avg(c{i}) AS m{i}" for i in at.values())
    within = ", ".join(f"(c{i} - avg(c{i}) {over}) / s{i} AS d{i}" for i in at.values())
    sums = ", ".join(f"sum(d{i} * d{j}) AS p_{i}_{j}" for i, j in pairs)
    cells = ", ".join(f"{{'a': {i}, 'b': {j}, 'v': p_{i}_{j}}}" for i, j in pairs)
    scales = ", ".join(f"{{'a': {i}, 's': s{i}, 'm': m{i}}}" for i in at.values())
    terms = ", ".join(f"('{s.name}', {i}, {at[c]}, '{c}')" for s in specs for i, c in enumerate(s.terms))
    targets = ", ".join(f"('{s.name}', {at[s.target]}, {len(s.terms)})" for s in specs)
    steps = []
    for p in range(k):
        steps.append(f"""
    g{p + 1} AS MATERIALIZED (
      SELECT x.spec, x.i, x.j, CASE WHEN y.v IS NULL THEN x.v WHEN x.i = {p} THEN x.v / y.v ELSE x.v - coalesce(z.v, 0) * coalesce(w.v, 0) / y.v END AS v
      FROM g{p} x LEFT JOIN g{p} y ON y.spec = x.spec AND y.i = {p} AND y.j = {p}
        LEFT JOIN g{p} z ON z.spec = x.spec AND z.i = x.i AND z.j = {p}
        LEFT JOIN g{p} w ON w.spec = x.spec AND w.i = {p} AND w.j = x.j)""")  # fmt: skip
    return f"""
    WITH source AS ({source}),
    raw AS (SELECT {entity} AS g, {read} FROM source),
    r AS MATERIALIZED (SELECT * FROM raw WHERE {" AND ".join(f"c{i} IS NOT NULL" for i in at.values())}),
    sc AS MATERIALIZED (SELECT count(*) AS n, count(DISTINCT g) AS entities, {sds} FROM r),
    d AS MATERIALIZED (SELECT g, {within} FROM r, sc),
    pg AS MATERIALIZED (SELECT g, c.a, c.b, c.v FROM (SELECT g, unnest([{cells}]) AS c FROM (SELECT g, {sums} FROM d GROUP BY g))),
    both_ways AS MATERIALIZED (SELECT g, a, b, v FROM pg UNION ALL SELECT g, b, a, v FROM pg WHERE a <> b),
    total AS MATERIALIZED (SELECT a, b, sum(v) AS v FROM both_ways GROUP BY a, b),
    scale AS MATERIALIZED (SELECT c.a, c.s, c.m FROM (SELECT unnest([{scales}]) AS c FROM sc)),
    st(spec, i, col, term) AS (VALUES {terms}),
    ta(spec, y, size) AS (VALUES {targets}),
    g0 AS MATERIALIZED (
      SELECT s.spec, s.i, q.i AS j, v FROM st s JOIN st q ON q.spec = s.spec JOIN total ON a = s.col AND b = q.col
      UNION ALL SELECT s.spec, s.i, {RHS}, v FROM st s JOIN ta USING (spec) JOIN total ON a = s.col AND b = y
      UNION ALL SELECT s.spec, s.i, {UNIT} + q.i, (s.i = q.i)::INT::DOUBLE FROM st s JOIN st q ON q.spec = s.spec),
    {",".join(steps)},
    beta AS MATERIALIZED (SELECT spec, i, v AS b FROM g{k} WHERE j = {RHS}),
    inv AS MATERIALIZED (SELECT spec, i, j - {UNIT} AS j, v FROM g{k} WHERE j >= {UNIT}),
    fitted AS (
      SELECT s.spec, s.i, e.g, sum(bt.b * e.v) AS v FROM st s JOIN st q ON q.spec = s.spec
      JOIN beta bt ON bt.spec = s.spec AND bt.i = q.i JOIN both_ways e ON e.a = s.col AND e.b = q.col GROUP BY s.spec, s.i, e.g),
    score AS MATERIALIZED (
      SELECT f.spec, f.i, f.g, e.v - f.v AS v FROM fitted f JOIN st s ON s.spec = f.spec AND s.i = f.i JOIN ta ON ta.spec = f.spec
      JOIN both_ways e ON e.g = f.g AND e.a = s.col AND e.b = ta.y),
    meat AS MATERIALIZED (
      SELECT x.spec, x.i, y.i AS j, sum(x.v * y.v) AS v FROM score x JOIN score y ON y.spec = x.spec AND y.g = x.g GROUP BY x.spec, x.i, y.i),
    half AS MATERIALIZED (
      SELECT a.spec, a.i, m.j, sum(a.v * m.v) AS v FROM inv a JOIN meat m ON m.spec = a.spec AND m.i = a.j GROUP BY a.spec, a.i, m.j),
    residual AS MATERIALIZED (
      SELECT ta.spec, (any_value(yy.v) - sum(bt.b * b.v)) / any_value(n - size - 1) AS v
      FROM ta JOIN st s ON s.spec = ta.spec JOIN beta bt ON bt.spec = s.spec AND bt.i = s.i
      JOIN total b ON b.a = s.col AND b.b = ta.y JOIN total yy ON yy.a = ta.y AND yy.b = ta.y, sc GROUP BY ta.spec),
    clustered AS (
      SELECT h.spec, h.i, a.j, sum(h.v * a.v) * any_value(n / (n - size - 1)::DOUBLE) AS v
      FROM half h JOIN inv a ON a.spec = h.spec AND a.i = h.j JOIN ta ON ta.spec = h.spec, sc GROUP BY h.spec, h.i, a.j),
    alike AS (SELECT a.spec, a.i, a.j, a.v * e.v AS v FROM inv a JOIN residual e ON e.spec = a.spec),
    cov AS MATERIALIZED (SELECT * FROM {"clustered" if effects else "alike"}),
    slopes AS MATERIALIZED (
      SELECT s.spec, s.i, s.term, bt.b * sy.s / sx.s AS coef, sqrt(c.v) * sy.s / sx.s AS se, sx.m, sx.s, sy.s AS ys, sy.m AS ym
      FROM st s JOIN ta ON ta.spec = s.spec JOIN beta bt ON bt.spec = s.spec AND bt.i = s.i JOIN cov c ON c.spec = s.spec AND c.i = s.i AND c.j = s.i
      JOIN scale sx ON sx.a = s.col JOIN scale sy ON sy.a = ta.y),
    level AS (
      SELECT spec, any_value(ym) - sum(coef * m) AS coef FROM slopes GROUP BY spec),
    level_var AS (
      SELECT c.spec, sqrt(sum(c.v * x.m / x.s * x.ys * y.m / y.s * y.ys) + {"0" if effects else "any_value(e.v * x.ys * x.ys / n)"}) AS se
      FROM cov c JOIN residual e ON e.spec = c.spec JOIN slopes x ON x.spec = c.spec AND x.i = c.i JOIN slopes y ON y.spec = c.spec AND y.i = c.j, sc GROUP BY c.spec),
    lines AS (
      SELECT spec, term, coef, se FROM slopes UNION ALL SELECT spec, 'const', coef, se FROM level JOIN level_var USING (spec)),
    quality AS (
      SELECT ta.spec, sum(bt.b * b.v) / any_value(yy.v) AS r2
      FROM ta JOIN st s ON s.spec = ta.spec JOIN beta bt ON bt.spec = s.spec AND bt.i = s.i
      JOIN total b ON b.a = s.col AND b.b = ta.y JOIN total yy ON yy.a = ta.y AND yy.b = ta.y GROUP BY ta.spec),
    final AS (
      SELECT l.spec AS model, term, coef, se, coef / se AS t, n, entities, r2, n - size - 1 - ({absorbed}) AS df
      FROM lines l JOIN ta ON ta.spec = l.spec JOIN quality ON quality.spec = l.spec, sc)
    SELECT model, term, round(coef, 7) + 0 AS coef, round(se, 7) + 0 AS se, round(t, 4) + 0 AS t, round({t_pvalue_sql("t", "df")}, 6) + 0 AS p,
      n, entities, round(r2, 7) + 0 AS r2 FROM final"""


def each_model_sql(source: str, columns: dict[str, str], specs: Sequence[Spec]) -> str:
    """`ols_sql` model by model over one source, so that a row only has to have the model's own columns."""
    parts = " UNION ALL ".join(f"SELECT * FROM ({ols_sql('SELECT * FROM panel0', columns, [s])})" for s in specs)
    return f"WITH panel0 AS MATERIALIZED ({source}) {parts}"


def elastic_net_sql(source: str, columns: dict[str, str], s: Spec, penalty: float, mix: float = 0.5, sweeps: int = 400) -> str:
    """A penalised pooled model by coordinate descent: one step of a recursive table for each coordinate in turn."""
    names = [s.target, *s.terms]
    k = len(s.terms)
    read = ", ".join(f"({columns.get(c, c)})::DOUBLE AS c{i}" for i, c in enumerate(names))
    kept = " AND ".join(f"c{i} IS NOT NULL" for i in range(k + 1))
    scaled = ", ".join(f"(c{i} - avg(c{i}) OVER ()) / stddev_samp(c{i}) OVER () AS d{i}" for i in range(k + 1))
    gram = ", ".join("[" + ", ".join(f"avg(d{i} * d{j})" for j in range(1, k + 1)) + "]" for i in range(1, k + 1))
    cross = ", ".join(f"avg(d0 * d{i})" for i in range(1, k + 1))
    ends = ", ".join(f"avg(c{i}) AS m{i}, stddev_samp(c{i}) AS s{i}" for i in range(k + 1))
    dot = "list_dot_product(gram[j], b)"
    pull = f"(crossed[j] - {dot} + gram[j][j] * b[j])"
    new = f"sign({pull}) * greatest(abs({pull}) - {penalty * mix}, 0) / (gram[j][j] + {penalty * (1 - mix)})"
    coef = ", ".join(f"b[{i}] * s0 / s{i}" for i in range(1, k + 1))
    level = " - ".join(["m0", *(f"b[{i}] * s0 / s{i} * m{i}" for i in range(1, k + 1))])
    terms = ", ".join(f"'{c}'" for c in ("const", *s.terms))
    return f"""
    WITH RECURSIVE rows0 AS MATERIALIZED (SELECT * FROM (SELECT {read} FROM ({source})) WHERE {kept}),
    g AS MATERIALIZED (SELECT [{gram}] AS gram, [{cross}] AS crossed FROM (SELECT {scaled} FROM rows0)),
    cd(step, b) AS (
      SELECT 0, list_transform(range({k}), lambda i: 0::DOUBLE)
      UNION ALL
      SELECT step + 1, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = j THEN {new} ELSE b[i] END)
      FROM (SELECT step, b, step % {k} + 1 AS j FROM cd WHERE step < {k * sweeps}), g),
    last AS (SELECT b FROM cd WHERE step = {k * sweeps}),
    ends AS (SELECT {ends} FROM rows0)
    SELECT unnest([{terms}]) AS term, round(unnest([{level}, {coef}]), 7) + 0 AS coef FROM last, ends"""
