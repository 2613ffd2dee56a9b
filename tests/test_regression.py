"""Panel fits against dense dummy-variable least squares."""

import math

import numpy as np
import pytest

from tidemark.operators import regression as reg


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    made = []
    for g in range(12):
        for _ in range(int(rng.integers(2, 30))):
            a, b = rng.normal(5, 2), rng.normal(1e6, 3e5)
            made.append((f"s{g}", float(0.5 * a + 2e-6 * b + g + rng.normal()), float(a), float(b), float(2 * a), float(g), 3.0))
    return made, spark.createDataFrame(made, "symbol string, y double, a double, b double, twice double, own double, flat double")


def dense(made, cols, effects):
    y = np.array([m[1] for m in made])
    x = np.column_stack([[m[c] for m in made] for c in cols])
    groups = np.array([m[0] for m in made])
    n = len(y)
    if effects:
        y2, x2 = y.copy(), x.astype(float).copy()
        for g in set(groups):
            at = groups == g
            y2[at] -= y[at].mean()
            x2[at] -= x[at].mean(axis=0)
        y2, x2 = y2 + y.mean(), x2 + x.mean(axis=0)
    else:
        y2, x2 = y, x
    z = np.column_stack([np.ones(n), x2])
    beta = np.linalg.solve(z.T @ z, z.T @ y2)
    e = y2 - z @ beta
    bread = np.linalg.inv(z.T @ z)
    meat = sum(np.outer(s, s) for s in (z[groups == g].T @ e[groups == g] for g in set(groups)))
    k = z.shape[1]
    return beta, bread @ meat @ bread * n / (n - k), bread * (e @ e), n, k


def test_clustered_panel_fit(spark, panel):
    made, df = panel
    mom = reg.moments(df, "symbol", ["y", "a", "b"])
    out = {r["term"]: r for r in reg.panel_ols(mom, [reg.spec("m", "y", "a", "b")]).collect()}
    beta, cov, _, n, _ = dense(made, [2, 3], True)
    for i, term in enumerate(("const", "a", "b")):
        assert math.isclose(out[term]["coef"], beta[i], rel_tol=1e-8), term
        assert math.isclose(out[term]["se"], math.sqrt(cov[i, i]), rel_tol=1e-6), term
    assert out["a"]["n"] == n and out["a"]["entities"] == 12


def test_absorbed_terms_drop(spark, panel):
    _, df = panel
    mom = reg.moments(df, "symbol", ["y", "a", "twice", "own", "flat"])
    out = reg.panel_ols(mom, [reg.spec("m", "y", "a", "twice", "own", "flat")])
    assert {r["term"] for r in out.collect()} == {"const", "a"}


def test_pooled_fit(spark, panel):
    made, df = panel
    mom = reg.moments(df, "symbol", ["y", "a", "b"])
    out = {r["term"]: r for r in reg.pooled_ols(mom, [reg.spec("m", "y", "a", "b")]).collect()}
    beta, _, cov, n, k = dense(made, [2, 3], False)
    for i, term in enumerate(("const", "a", "b")):
        assert math.isclose(out[term]["coef"], beta[i], rel_tol=1e-7)
        assert math.isclose(out[term]["se"], math.sqrt(cov[i, i] / (n - k)), rel_tol=1e-6)


def test_elimination_keeps_what_matters(spark, panel):
    made, _ = panel
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(*m[:4], float(v)) for m, v in zip(made, rng.normal(size=len(made)))],
                               "symbol string, y double, a double, b double, noise double")
    mom = reg.moments(df, "symbol", ["y", "a", "b", "noise"])
    out = reg.eliminate(mom, reg.spec("m", "y", "a", "b", "noise"), p_limit=0.01).collect()
    final = {r["term"] for r in out if r["model"] == "final"}
    assert {"a", "b"} <= final and "noise" not in final
    kept = reg.eliminate(mom, reg.spec("m", "y", "a", "b", "noise"), keep=("noise",), p_limit=0.01).collect()
    assert "noise" in {r["term"] for r in kept if r["model"] == "final"}


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803477074037), (-1.5, 3, 0.23058444), (0.0, 5, 1.0), (12.706204736, 1, 0.05)])
def test_t_pvalue(t, df, p):
    assert math.isclose(reg.t_pvalue(t, df), p, rel_tol=1e-5)


def test_each_model_uses_its_own_rows(spark):
    rng = np.random.default_rng(3)
    made = []
    for i in range(400):
        a, b, c = (None if rng.random() < 0.15 else float(x) for x in rng.normal(size=3))
        y = float((a or 0) - 2 * (b or 0) + i % 7 + rng.normal())
        made.append((f"s{i % 7}" if i % 50 else None, y if i % 13 else None, a, b, float("nan") if c is None and i % 2 else c, None))
    df = spark.createDataFrame(made, "symbol string, y double, a double, b double, c double, never double")
    specs = [reg.spec("m1", "y", "a"), reg.spec("m2", "y", "a", "b"), reg.spec("m3", "c", "b"), reg.spec("m4", "y", "b", "c"), reg.spec("m5", "y", "never")]
    got = {(r.model, r.term): r for r in reg.fit_panel(df, "symbol", specs).collect()}
    assert {m for m, _ in got} == {"m1", "m2", "m3", "m4"}
    for s in specs[:4]:
        own = reg.panel_ols(reg.moments(df.na.drop(subset=[s.target, *s.terms]), "symbol", [s.target, *s.terms]), [s]).collect()
        for r in own:
            mine = got.pop((r.model, r.term))
            assert (mine.n, mine.entities) == (r.n, r.entities)
            assert all(math.isclose(mine[c], r[c], rel_tol=1e-7, abs_tol=1e-9) for c in ("coef", "se", "t", "r2"))
    assert not got


@pytest.mark.parametrize("penalty,mix", [(0.0, 0.5), (0.05, 0.5), (0.3, 1.0), (0.2, 0.0), (5.0, 1.0)])
def test_elastic_net_meets_its_conditions(spark, panel, penalty, mix):
    made, df = panel
    s = reg.spec("net", "y", "a", "b", "own", "flat")
    got = {r.term: r.coef for r in reg.elastic_net(reg.moments(df, "symbol", ["y", *s.terms]), s, penalty, mix).collect()}
    y, x = np.array([m[1] for m in made]), np.array([[m[2], m[3], m[5], m[6]] for m in made])
    size = np.where(x.std(axis=0, ddof=1) > 0, x.std(axis=0, ddof=1), 1.0)
    b = np.array([got[c] for c in s.terms]) * size / y.std(ddof=1)
    e = (y - got["const"] - x @ [got[c] for c in s.terms]) / y.std(ddof=1)
    assert abs(e.mean()) < 1e-8
    pull = ((x - x.mean(axis=0)) / size).T @ e / len(y) - penalty * (1 - mix) * b
    for g, v in zip(pull, b):
        assert math.isclose(g, math.copysign(penalty * mix, v), abs_tol=1e-7) if abs(v) > 1e-12 else abs(g) <= penalty * mix + 1e-7


def test_one_matrix_per_entity_and_part_over_its_own_columns(spark):
    rng = np.random.default_rng(5)
    names = [f"c{i}" for i in range(6)]
    made = [(f"s{i % 40}", *[None if rng.random() < 0.3 else float(x) for x in rng.normal(size=6)]) for i in range(600)]
    df = spark.createDataFrame(made, "symbol string, " + ", ".join(f"{c} double" for c in names)).repartition(7)
    specs = [reg.spec("a", "c0", "c1"), reg.spec("b", "c2", "c3"), reg.spec("c", "c4", "c5"), reg.spec("d", "c4", "c5")]
    found = reg.moments_by_rows(df, "symbol", specs)
    assert [[s.name for s in some] for _, some in found] == [["a"], ["b"], ["c", "d"]]
    for mom, _ in found:
        got = {r.entity: r.m for r in mom.products.collect()}
        assert mom.products.count() == len(got) == mom.entities and {len(m) for m in got.values()} == {6}
        at = [1 + names.index(c) for c in mom.columns]
        for name, m in got.items():
            own = [[r[i] for i in at] for r in made if r[0] == name and None not in [r[i] for i in at]]
            z = np.column_stack([np.ones(len(own)), (np.array(own) - [mom.shift[c] for c in mom.columns]) / [mom.scale[c] for c in mom.columns]])
            assert np.allclose(m, (z.T @ z)[np.triu_indices(3)])


def test_products_come_without_unfolding(spark):
    df = spark.createDataFrame([(f"s{i}", float(i), float(i * i % 7)) for i in range(50)], "symbol string, y double, a double")
    products = reg.entity_products(df, "symbol", ["y", "a"], {}, {})
    plan = products._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
