"""Classifiers on rows whose classes can be told apart, and panels of a hand-made study."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classifiers as cl, event_panel as ep, vector_clusters as vc
from tidemark.operators.labels import PRODUCTS


@pytest.fixture(scope="module")
def apart(spark):
    """y is 1 where a is above 0; b says nothing."""
    rows = [(f"k{i}", float(i % 2) * 2 - 1 + 0.01 * (i % 7), float(i % 5), i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "key string, a double, b double, y int")


@pytest.mark.parametrize("kind", ["lr", "rf"])
def test_cross_validation(apart, kind):
    (row,) = cl.cross_validate(apart, ["a", "b"], "y", kind, k=3).collect()
    assert row["weighted_f1"] == 1.0 and row["folds"] == 3


def test_importances_find_the_feature(apart):
    got = {r["feature"]: r["importance"] for r in cl.importances(apart, ["a", "b"], "y").collect()}
    assert got["a"] > 0.9


def test_train_and_test(apart):
    out = {r["split"]: r for r in cl.train_and_test(apart, ["a", "b"], "y", "rf", "key").collect()}
    assert out["train"]["auc"] == out["test"]["auc"] == 1.0 and out["test"]["gini"] == 1.0


def test_draws_are_repeatable_and_in_range():
    one, two = cl.draw_settings("rf", 50), cl.draw_settings("rf", 50)
    assert one == two and len({str(s) for s in one}) > 40
    assert all(5 <= s["numTrees"] <= 200 and 3 <= s["maxDepth"] <= 30 for s in one)
    assert all(1 <= s["regParam"] <= 100 for s in cl.draw_settings("lr", 50))
    assert cl.TRIALS == {"lr": 100, "rf": 100, "gbt": 200}


def test_search_scores_the_refitted_winner(apart):
    rows = cl.search(apart, ["a", "b"], "y", "lr", "key", trials=3).collect()
    assert len(rows) == 3 and sum(r["best"] for r in rows) == 1
    assert all((r["test_weighted_f1"] is not None) == r["best"] for r in rows)
    again = cl.search(apart.repartition(7), ["a", "b"], "y", "lr", "key", trials=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(i, "good fine news today" if i % 2 else "bad poor story now", i % 2, f"201{5 + i % 3}-01-01", "ab"[i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label int, published string, subject string")
    return df.withColumn("published", F.to_date("published"))


@pytest.mark.parametrize("kind", ["lr", "svm"])
def test_text_baseline(articles, kind):
    (row,) = cl.text_baseline(articles, "text", "label", "doc_id", kind).collect()
    assert row["f1"] == row["accuracy"] == 1.0


def test_fold_metrics_and_time_validation(spark, articles):
    rows = cl.with_words(articles, "text", "label")
    (row,) = cl.fold_metrics(rows.where("year(published) < 2017"), rows.where("year(published) >= 2017"), "doc_id").collect()
    assert row["train_samples"] + row["eval_samples"] == 60 and row["test_samples"] == 30 and row["test_f1"] == 1.0
    folds = spark.createDataFrame([(2016,), (2017,)], "test_year int")
    out = cl.validation(cl.year_folds(rows, folds, "published"), "doc_id").collect()
    assert [r["test_year"] for r in out] == [2016, 2017] and all(r["test_accuracy"] == 1.0 for r in out)


def test_relevance_model(spark):
    words = ["up rise gain", "flat same calm", "down fall loss"]
    rows = [(f"k{i}", words[i % 3], i % 3) for i in range(90)]
    out = cl.relevance_model(spark.createDataFrame(rows, "key string, text string, label int"), "key").collect()
    assert {r["split"]: r["weighted_f1"] for r in out} == {"train": 1.0, "test": 1.0}


def test_event_panel_sums_by_event(spark):
    start = dt.date(2020, 1, 1)
    rows = []
    for i in range(6):
        event = None if i == 0 else 1 + (i > 3)
        rows.append((1, start + dt.timedelta(days=i), event, 10 * i, 0.5 * i, 20.0 + i, 1, 0, *[i] * len(PRODUCTS)))
    df = spark.createDataFrame(
        rows, "symbol int, date date, event_only_index int, volume long, returns double, vix_close double, event int, illiq int, "
        + ", ".join(f"{p} int" for p in PRODUCTS),
    )
    df = df.withColumns({c: F.lit(1.0) for c in ep.ROLLED_NAMES} | {"event_id": F.lit(1), "positive": F.lit(1), "negative": F.lit(3)})
    first = {r["event_only_index"]: r for r in ep.event_panel(df).collect()}
    assert first[1]["volume"] == 60 and first[2]["volume"] == 90 and first[1]["returns"] == 3.0
    assert first[1]["vix_index_avg"] == 22.0 and first[1]["date"] == start + dt.timedelta(days=1)
    assert first[2]["uncert"] == 0.25 and first[2][f"{PRODUCTS[0]}_uncert"] == 9 * 0.25
    last = {r["event_only_index"]: r["date"] for r in ep.event_panel(df, "last").collect()}
    assert last == {1: start + dt.timedelta(days=3), 2: start + dt.timedelta(days=5)}


@pytest.mark.parametrize("eps", [0.001, 0.05, 0.6, 1.5])
def test_vector_slices_are_exact(spark, eps):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    x[10:20] = x[0] + 0.02 * rng.normal(size=(10, 4))
    x[30] = 0
    df = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "id long, b string, v array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    root = list(range(90))
    for _ in range(90):
        for i in range(90):
            for j in range(i):
                if i % 2 == j % 2 and 30 not in (i, j) and 1 - unit[i] @ unit[j] <= eps:
                    root[i] = root[j] = min(root[i], root[j])
    want = {i: r if root.count(r) > 1 else -1 for i, r in enumerate(root)}
    got = {r["id"]: r["cluster"] for r in vc.vector_clusters(df, "id", "v", "b", eps, part_rows=7).collect()}
    assert got == want


def test_pairs_with_one_training_domain_share_a_fit(spark, monkeypatch):
    """Three domains pair up in four folds that train on two domains."""
    texts = [(i, "good news here" if i % 2 else "bad thing there", i % 2, f"s{i % 4}" if i % 4 < 3 else f"s{3 + i % 8 // 4 * 2}") for i in range(160)]
    df = cl.with_words(spark.createDataFrame(texts, "doc_id long, text string, label int, subject string"), "text", "label")
    subjects = {1: ["s1", "s0"], 2: ["s1", "s2"], 3: ["s3", "s0"]}
    pairs = [(a, b, f"d{a}", f"d{b}", subjects[a], subjects[b]) for a, b in ((1, 2), (1, 3), (2, 1), (2, 3))]
    names = ("train_no", "test_no", "train_domain", "test_domain", "train_subjects", "test_subjects")
    pairs = spark.createDataFrame(pairs, ", ".join(f"{n} {t}" for n, t in zip(names, ["int"] * 2 + ["string"] * 2 + ["array<string>"] * 2)))
    made, fits = cl.text_pipeline, []
    monkeypatch.setattr(cl, "text_pipeline", lambda *a: fits.append(a) or made(*a))
    found = cl.validation(cl.domain_folds(df, pairs), "doc_id").orderBy("train_domain", "test_domain").collect()
    assert [(r["train_domain"], r["test_domain"]) for r in found] == [("d1", "d2"), ("d1", "d3"), ("d2", "d1"), ("d2", "d3")]
    assert all(r["test_f1"] == 1.0 for r in found) and len(fits) == 2
    alone = cl.fold_metrics(*[df.where(F.col("subject").isin(subjects[d])) for d in (1, 3)], "doc_id").first()
    assert tuple(found[1])[2:] == tuple(alone)


def _direction(spark, n=400):
    rows = spark.range(0, n, 1, 1).select(
        F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"),
        F.when(F.col("id") % 7 > 3, 1).otherwise(0).alias("up"),
    )
    return rows


def test_folds_are_fitted_once_each_and_on_all_cores(spark, monkeypatch):
    from pyspark.ml import Pipeline

    fitted, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, rows, *a: fitted.append((rows.count(), rows.rdd.getNumPartitions())) or fit(self, rows, *a))
    got = cl.cross_validate(_direction(spark), ["a", "b"], "up", "rf", k=4).first()
    assert (got["model"], got["folds"]) == ("rf", 4) and got["weighted_f1"] == 1.0
    assert len(fitted) == 4 and sum(n for n, _ in fitted) == 3 * 400
    assert all(parts >= spark.sparkContext.defaultParallelism for _, parts in fitted)


def test_searches_fit_on_all_cores(spark, monkeypatch):
    from pyspark.ml import Pipeline

    parts, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, rows, *a: parts.append(rows.rdd.getNumPartitions()) or fit(self, rows, *a))
    got = cl.search(_direction(spark), ["a", "b"], "up", "lr", "key", trials=2).collect()
    assert len(got) == 2 and len(parts) == 3
    assert min(parts) >= spark.sparkContext.defaultParallelism


def test_rows_are_dealt_evenly_and_let_go(spark, monkeypatch):
    monkeypatch.setattr(cl, "ROWS_A_TASK", 10)
    with cl.dealt(spark.range(0, 400, 1, 1)) as held:
        assert held.rdd.getNumPartitions() == 40 and held.is_cached
        sizes = [r[1] for r in held.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 40 and max(sizes) - min(sizes) <= 1
    assert not held.is_cached


@pytest.fixture(scope="module")
def many_domains(spark):
    """Three subjects of true articles, two of fake ones; every fifth article is labelled the other way."""
    texts = [(i, "good news here" if i % 5 % 2 else "bad thing there", int((i % 5 < 3) != (i % 25 < 5)), f"s{i % 5}") for i in range(250)]
    return spark.createDataFrame(texts, "doc_id long, text string, label int, subject string")


def test_every_pair_of_domains_is_validated(many_domains, monkeypatch):
    from types import SimpleNamespace

    from tidemark.operators import folds
    from tidemark.plans import modelling

    made, fits = cl.text_pipeline, []
    monkeypatch.setattr(cl, "text_pipeline", lambda *a: fits.append(a) or made(*a))
    df = cl.with_words(many_domains, "text", "label")
    domains = {r["domain"]: (r["true_subject"], r["fake_subject"]) for r in folds.domains(df, None, 2).collect()}
    got = {(r["train_domain"], r["test_domain"]): r for r in modelling.domain_results(SimpleNamespace(articles=many_domains)).collect()}
    names = {f"{t} vs {f}": [t, f] for t, f in domains.values()}
    assert len(names) > 4 and set(got) == {(a, b) for a in names for b in names if a != b}
    assert len(fits) == len({frozenset(s) for s in names.values()})
    for a, b in list(got)[:: len(got) // 3]:
        alone = cl.fold_metrics(*[df.where(F.col("subject").isin(names[d])) for d in (a, b)], "doc_id").first()
        assert tuple(got[a, b])[2:] == pytest.approx(tuple(alone))


def test_matrix_has_every_domain(many_domains):
    from types import SimpleNamespace

    from tidemark.plans import modelling

    out = modelling.domain_f1_matrix(SimpleNamespace(articles=many_domains.where("doc_id % 5 <> 1")))
    rows = out.collect()
    assert len(rows) > 4 and len(out.columns) == len(rows) + 1
    assert all(sum(v is None for v in r[1:]) == 1 for r in rows)  # a domain is not tested on itself


def test_texts_that_share_no_word_are_given_the_larger_class(spark):
    rows = cl.with_words(spark.createDataFrame([("one", 1), ("two", 1), ("three", 0)], "text string, label int"), "text", "label")
    assert {r["prediction"] for r in cl._words_scorer("lr", rows)(rows).collect()} == {1.0}


def test_search_query_draws_the_studied_numbers(spark, monkeypatch):
    from tidemark.plans import modelling

    drawn, settings = {}, cl.draw_settings

    def search(rows, features, label, kind, key, trials=None):
        drawn[kind] = len(settings(kind, trials or cl.TRIALS[kind]))
        return spark.range(1)

    monkeypatch.setattr(cl, "search", search)
    monkeypatch.setattr(modelling, "direction_rows", lambda t: spark.range(1))
    modelling.param_search(None)
    assert drawn == {"lr": 100, "rf": 100, "gbt": 200}
