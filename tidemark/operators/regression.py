"""Panel regressions from one pass of cross-products.

The rows are reduced to one cross-product matrix per entity; every
specification, its coefficients and its clustered errors come from those. What
reaches the driver is a handful of k by k matrices, k being the number of
columns.

Conventions, as in the usual panel least-squares packages: entity effects are
swept out and the grand mean added back, so that a constant stays in the model;
clustered covariance is scaled by n / (n - k), without a correction for the
number of clusters unless asked for; p-values use Student's t with n - k -
(entities - 1) degrees of freedom.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.reshape import side_by_side, union_all
from tidemark.session import cut_lineage

RESULT = "model string, term string, coef double, se double, t double, p double, n bigint, entities bigint, r2 double"
TINY = 1e-10
NUMBERS_HELD = 1_000_000  # numbers in the matrices that a task unfolds together


@dataclass(frozen=True)
class Spec:
    """One model: a target and its terms; a constant is always included."""

    name: str
    target: str
    terms: tuple[str, ...]


def spec(name: str, target: str, *terms: str) -> Spec:
    return Spec(name, target, tuple(terms))


# -- Student's t --------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction for the incomplete beta function."""
    c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + num * d) or 1e-300)
            c = (1.0 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value."""
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


# -- moments ------------------------------------------------------------------


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def entity_products(
    df: DataFrame, entity: str, columns: list[str], shift: dict[str, float], scale: dict[str, float], parts: list[list[str]] | None = None
) -> DataFrame:
    """(entity, part, m): the flattened upper triangle of sum(z z') for z = (1, columns of the part).

    A part is some of the columns (all of them, if none is named) and takes the rows that
    have them all. An entity's rows lie together in one task, which adds them up as they
    pass and holds the sums of one batch: a row is shuffled once, a matrix never, however
    few rows an entity has. Panels have one row per entity and day, or event, at most.
    """
    parts = [columns] if parts is None else parts
    moves = np.array([shift.get(c, 0.0) for c in columns])
    sizes = np.array([scale.get(c, 1.0) for c in columns])
    at = [[0, *[1 + columns.index(c) for c in part]] for part in parts]
    upper = [np.triu_indices(len(own)) for own in at]

    def out(done: list) -> pd.DataFrame:
        return pd.DataFrame(done, columns=["entity", "part", "m"])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, open_sums = None, {}
        for pdf in batches:
            if not len(pdf):
                continue
            done: list = []
            z = np.column_stack([np.ones(len(pdf)), (pdf[columns].to_numpy(dtype=float) - moves) / sizes])
            codes = pd.factorize(pdf["entity"])[0]
            for lines in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(codes)) + 1):
                first = pdf["entity"].iat[lines[0]]
                first = None if pd.isna(first) else first
                if first != name:
                    done += [(name, i, m) for i, m in open_sums.items()]
                    name, open_sums = first, {}
                here = z[lines]
                whole = not np.isnan(here).any()
                for i, own in enumerate(at):
                    mine = here[:, own]
                    mine = mine if whole else mine[~np.isnan(mine).any(axis=1)]
                    if len(mine):
                        open_sums[i] = open_sums.get(i, 0.0) + (mine.T @ mine)[upper[i]]
            if done:
                yield out(done)
        if open_sums:
            yield out([(name, i, m) for i, m in open_sums.items()])

    rows = df.select(F.col(entity).alias("entity"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)])
    kind = rows.schema["entity"].dataType.simpleString()
    together = rows.repartition("entity").sortWithinPartitions("entity")
    return together.mapInPandas(sums, f"entity {kind}, part int, m array<double>")


def _matrices(flat: pd.Series, k: int) -> np.ndarray:
    """(entities, k, k) from flattened triangles."""
    values = np.vstack(flat.to_numpy())
    out = np.zeros((len(values), k, k))
    for at, (i, j) in enumerate(_pairs(k)):
        out[:, i, j] = out[:, j, i] = values[:, at]
    return out


def _within(m: np.ndarray) -> np.ndarray:
    """Cross-products around each entity's own means."""
    sums = m[:, 0, :]
    return m - sums[:, :, None] * sums[:, None, :] / m[:, 0, 0][:, None, None]


def _slices(pdf: pd.DataFrame, k: int) -> Iterator[np.ndarray]:
    """The matrices of a batch, some at a time."""
    size = max(1, NUMBERS_HELD // (k * k))
    for start in range(0, len(pdf), size):
        yield _matrices(pdf["m"].iloc[start : start + size], k)


def _totals(products: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k by k matrix summed over entities, as it is and around their means, and the entities; added up on the executors."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(2 * k * k + 1)
        for pdf in batches:
            for m in _slices(pdf, k):
                sums += np.concatenate([m.sum(axis=0).ravel(), _within(m).sum(axis=0).ravel(), [len(m)]])
        yield pd.DataFrame({"at": np.arange(len(sums)), "x": sums})

    cells = products.select("m").mapInPandas(partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(2 * k * k + 1)
    for row in cells:
        out[row["at"]] = row["x"]
    plain, inside = out[:-1].reshape(2, k, k)
    return plain, inside, int(round(out[-1]))


@dataclass
class Moments:
    """Cross-products of one set of columns, per entity and in total."""

    spark: SparkSession
    products: DataFrame
    columns: list[str]
    shift: dict[str, float]
    scale: dict[str, float]
    total: np.ndarray
    inside: np.ndarray
    entities: int
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.names = ["const", *self.columns]

    @property
    def n(self) -> int:
        return int(round(self.total[0, 0]))

    def at(self, *names: str) -> list[int]:
        return [self.names.index(n) for n in names]


def moments(df: DataFrame, entity: str, columns: list[str]) -> Moments:
    """One pass for centre and spread, one for the products.

    Rows that lack any of the columns are left out, as a fit would.
    """
    rows = cut_lineage(df.select(entity, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop())
    stats = rows.agg(*[f(c).alias(f"{c}|{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    shift = {c: stats[f"{c}|m"] or 0.0 for c in columns}
    scale = {c: (stats[f"{c}|s"] or 0.0) or 1.0 for c in columns}
    products = cut_lineage(entity_products(rows, entity, columns, shift, scale))
    return Moments(df.sparkSession, products, columns, shift, scale, *_totals(products, len(columns) + 1))


def moments_by_rows(df: DataFrame, entity: str, specs: list[Spec]) -> list[tuple[Moments, list[Spec]]]:
    """Moments for groups of models: a model uses every row that has its own columns, whatever else is missing.

    Still two passes: rows say which models they serve, models with the same rows form a
    part, and the products of every part are added up by entity, over its own columns alone.
    """
    columns = list(dict.fromkeys(c for s in specs for c in (s.target, *s.terms)))
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    rows = cut_lineage(df.where(F.col(entity).isNotNull()).select(entity, *[v.alias(c) for c, v in value.items()]))
    stats = rows.agg(*[f(c).alias(f"{c}|{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    shift = {c: stats[f"{c}|m"] or 0.0 for c in columns}
    scale = {c: (stats[f"{c}|s"] or 0.0) or 1.0 for c in columns}
    has = lambda s: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (s.target, *s.terms)])
    serves = [F.when(has(s), "x").otherwise("-") for s in specs]
    served = sorted(r[0] for r in rows.select(F.concat(*serves)).distinct().collect())
    groups: dict[tuple[str, ...], list[Spec]] = {}
    for i, s in enumerate(specs):
        groups.setdefault(tuple(p for p in served if p[i] == "x"), []).append(s)
    found = [some for rows_of, some in groups.items() if rows_of]
    parts = [list(dict.fromkeys(c for s in some for c in (s.target, *s.terms))) for some in found]
    products = cut_lineage(entity_products(rows, entity, columns, shift, scale, parts))
    out = []
    for i, (some, own) in enumerate(zip(found, parts)):
        mine = products.where(F.col("part") == i)
        out.append((Moments(df.sparkSession, mine, own, shift, scale, *_totals(mine, len(own) + 1)), some))
    return out


def fit_panel(df: DataFrame, entity: str, specs: list[Spec]) -> DataFrame:
    """`panel_ols` of each model over the rows that have its columns; models without rows are left out."""
    found = [panel_ols(mom, some) for mom, some in moments_by_rows(df, entity, specs)]
    return union_all(*found) if found else df.sparkSession.createDataFrame([], RESULT)


def long_moments(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """(i, j, value): cross-products around entity means, as rows."""
    products = entity_products(df.na.drop(subset=columns), entity, columns, {}, {})
    _, m, _ = _totals(products, len(columns) + 1)
    cells = [(columns[i - 1], columns[j - 1], float(m[i, j])) for i, j in _pairs(len(columns) + 1) if i > 0]
    return df.sparkSession.createDataFrame(cells, "i string, j string, value double")


# -- fits ---------------------------------------------------------------------


def _usable(a: np.ndarray, at: list[int]) -> list[int]:
    """Terms that entity effects or earlier terms do not absorb."""
    kept: list[int] = []
    for i in at:
        trial = kept + [i]
        sub = a[np.ix_(trial, trial)]
        d = np.sqrt(np.maximum(np.diag(sub), 0))
        if d[-1] < TINY * max(1.0, math.sqrt(abs(a[i, i]))) or d[-1] == 0:
            continue
        if np.linalg.eigvalsh(sub / np.outer(d, d))[0] > 1e-9:
            kept = trial
    return kept


def _rows(name, mom, names, coef, cov, df, n, r2):
    """Result rows in the units of the data."""
    out = []
    for term, b, v in zip(names, coef, np.diag(cov)):
        se = math.sqrt(max(v, 0.0))
        t = float(b) / se if se > 0 else float("nan")
        out.append((name, term, float(b), se, t, float(t_pvalue(t, df)), n, mom.entities, r2))
    return out


def _unscale(mom: Moments, target: str, kept: list[int]):
    """The linear map from scaled to original coefficients, constant first, and the offset."""
    sy, my = mom.scale[target], mom.shift[target]
    size = len(kept) + 1
    change = np.zeros((size, size))
    change[0, 0] = sy
    for r, i in enumerate(kept, start=1):
        c = mom.names[i]
        change[r, r] = sy / mom.scale[c]
        change[0, r] = -sy * mom.shift[c] / mom.scale[c]
    return change, my


def _design(mom: Moments, target: str, terms: tuple[str, ...], effects: bool):
    """Normal equations of the constant and the usable terms."""
    y = mom.at(target)[0]
    wanted = mom.at(*terms)
    n = mom.total[0, 0]
    mean = mom.total[0] / n
    # Around entity means with the grand mean back in, or as they are.
    full = mom.inside + n * np.outer(mean, mean) if effects else mom.total
    slopes = mom.inside if effects else mom.total - n * np.outer(mean, mean)
    kept = _usable(slopes, wanted)
    at = [0, *kept]
    a, b = full[np.ix_(at, at)], full[at, y]
    if effects:
        a[0, 0], a[0, 1:], a[1:, 0], b[0] = n, n * mean[kept], n * mean[kept], n * mean[y]
    beta = np.linalg.solve(a, b)
    yy = slopes[y, y]
    rss = yy - beta[1:] @ slopes[kept, y]
    return kept, a, beta, float(rss), float(1 - rss / yy) if yy > 0 else 0.0


def panel_ols(mom: Moments, specs: list[Spec], group_correction: bool = False) -> DataFrame:
    """Entity-effects least squares with errors clustered by entity, for many specs.

    All specs share the products; the clustered part is one more pass over the
    entity matrices for all of them together.
    """
    fits = {s.name: _design(mom, s.target, s.terms, True) for s in specs}
    k = len(mom.names)
    plans = [(s.name, mom.at(s.target)[0], fits[s.name][0], fits[s.name][2][1:]) for s in specs]

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meats = {name: np.zeros((len(kept), len(kept))) for name, _, kept, _ in plans}
        for pdf in batches:
            for m in _slices(pdf, k):
                w = _within(m)
                for name, y, kept, beta in plans:
                    s = w[:, kept, y] - np.einsum("gij,j->gi", w[np.ix_(range(len(w)), kept, kept)], beta)
                    meats[name] += s.T @ s
        for name, meat in meats.items():
            yield pd.DataFrame({"model": name, "at": np.arange(meat.size), "x": meat.ravel()})

    cells = (
        mom.products.select("m").mapInPandas(scores, "model string, at int, x double")
        .groupBy("model", "at").agg(F.sum("x").alias("x")).collect()
    )
    meats = {name: np.zeros(len(kept) ** 2) for name, _, kept, _ in plans}
    for row in cells:
        meats[row["model"]][row["at"]] = row["x"]

    n, out = mom.n, []
    for s in specs:
        kept, a, beta, _, r2 = fits[s.name]
        size = len(kept) + 1
        meat = np.zeros((size, size))
        meat[1:, 1:] = meats[s.name].reshape(len(kept), len(kept))
        bread = np.linalg.inv(a)
        cov = bread @ meat @ bread * n / (n - size)
        if group_correction:
            cov *= mom.entities / (mom.entities - 1) * (n - 1) / n
        change, offset = _unscale(mom, s.target, kept)
        coef = change @ beta
        coef[0] += offset
        names = ["const", *[mom.names[i] for i in kept]]
        out += _rows(s.name, mom, names, coef, change @ cov @ change.T, n - size - (mom.entities - 1), n, r2)
    return mom.spark.createDataFrame(out, RESULT)


def classical(mom: Moments, s: Spec, effects: bool) -> list[tuple]:
    """Least squares with homoskedastic errors, from the totals alone."""
    kept, a, beta, rss, r2 = _design(mom, s.target, s.terms, effects)
    n, size = mom.n, len(kept) + 1
    df = n - size - (mom.entities - 1 if effects else 0)
    cov = np.linalg.inv(a) * rss / df
    change, offset = _unscale(mom, s.target, kept)
    coef = change @ beta
    coef[0] += offset
    names = ["const", *[mom.names[i] for i in kept]]
    return _rows(s.name, mom, names, coef, change @ cov @ change.T, df, n, r2)


def pooled_ols(mom: Moments, specs: list[Spec]) -> DataFrame:
    rows = [r for s in specs for r in classical(mom, s, effects=False)]
    return mom.spark.createDataFrame(rows, RESULT)


def elastic_net(mom: Moments, s: Spec, penalty: float, mix: float = 0.5, sweeps: int = 10_000, tolerance: float = 1e-13) -> DataFrame:
    """term and coef of a pooled linear model that is penalised, by coordinate descent on the totals alone.

    For columns and target in units of their standard deviations it makes
    sum(e^2) / 2n + penalty * (mix * sum|b| + (1 - mix) * sum(b^2) / 2) least; the
    constant is free. The data is not read again, whatever the penalty.
    """
    n, mean = mom.total[0, 0], mom.total[0] / mom.total[0, 0]
    around = mom.total / n - np.outer(mean, mean)
    at, y = mom.at(*s.terms), mom.at(s.target)[0]
    gram, cross, b = around[np.ix_(at, at)], around[at, y], np.zeros(len(at))
    for _ in range(sweeps):
        before = b.copy()
        for j in range(len(at)):
            pull = cross[j] - gram[j] @ b + gram[j, j] * b[j]
            stiff = gram[j, j] + penalty * (1 - mix)
            b[j] = np.sign(pull) * max(abs(pull) - penalty * mix, 0.0) / stiff if stiff > 0 else 0.0
        if np.abs(b - before).max(initial=0.0) < tolerance:
            break
    coef = [b[j] * mom.scale[s.target] / mom.scale[c] for j, c in enumerate(s.terms)]
    centre = lambda c: mom.shift[c] + mom.scale[c] * mean[mom.at(c)[0]]
    const = centre(s.target) - sum(x * centre(c) for x, c in zip(coef, s.terms))
    return mom.spark.createDataFrame([("const", float(const)), *((c, float(x)) for c, x in zip(s.terms, coef))], "term string, coef double")


def eliminate(mom: Moments, s: Spec, keep: tuple[str, ...] = (), p_limit: float = 0.1) -> DataFrame:
    """General to specific: drop the weakest term until all that may go are below the limit.

    Every step is a smaller part of the same matrix; the data is not read again.
    """
    terms, step, out = list(s.terms), 0, []
    while True:
        fit = classical(mom, Spec(f"step_{step:02d}", s.target, tuple(terms)), effects=True)
        found = {r[1] for r in fit}
        terms = [t for t in terms if t in found]
        weak = [r for r in fit if r[1] not in ("const", *keep) and not (r[5] < p_limit)]
        if not weak:
            out += [("final", *r[1:]) for r in fit]
            break
        worst = max(weak, key=lambda r: (r[5] if r[5] == r[5] else 2.0, r[1]))
        out.append((f"step_{step:02d}_drop", *worst[1:]))
        terms.remove(worst[1])
        step += 1
    return mom.spark.createDataFrame(out, RESULT)


def compare(results: DataFrame, models: list[str]) -> DataFrame:
    """Coefficients, errors and p-values side by side, one row per term."""
    return side_by_side(results, "term", "model", models, ["coef", "se", "p"])
