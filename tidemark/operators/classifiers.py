"""Classifiers on Spark ML: direction of returns, articles, relevance."""

from __future__ import annotations

import math
import random
from contextlib import contextmanager
from functools import reduce
from itertools import groupby
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import words
from tidemark.operators import aggregates as agg, ranking
from tidemark.session import cut_lineage

SEED = 42


def _weighted_f1() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(metricName="f1")


def _assemble(features: list[str], scaled: bool) -> list:
    raw = VectorAssembler(inputCols=features, outputCol="raw" if scaled else "features", handleInvalid="skip")
    return [raw, StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scaled else [raw]


ROWS_A_TASK = 1 << 17
TEXTS_A_TASK = 2_000  # of a fit beside others: few texts fill one task, and the other cores have fits of their own


@contextmanager
def dealt(rows: DataFrame):
    """Stored rows dealt evenly over the cores, and held for the many passes of a fit.

    As they are stored they lie in as few parts as their bytes need, and a fit's work is in its
    trees, not in the bytes: it would run on a few cores alone.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    with let_go(rows.repartition(parts).persist()) as held:
        yield held


@contextmanager
def let_go(held: DataFrame):
    """Rows that are held for the passes inside."""
    try:
        yield held
    finally:
        held.unpersist()


def model_for(kind: str, **params):
    made = {
        "lr": lambda: LogisticRegression(),
        "rf": lambda: RandomForestClassifier(seed=SEED, numTrees=100),
        "gbt": lambda: GBTClassifier(seed=SEED, maxIter=100),
    }[kind]()
    return made.setParams(**params) if params else made


def cross_validate(df: DataFrame, features: list[str], label: str, kind: str, k: int = 5, key: str = "key") -> DataFrame:
    """Weighted F1 of k-fold cross-validation, one row per model.

    Folds are dealt out exactly and repeatably within each class.
    """
    rows = ranking.folds(df.withColumn("label", F.col(label).cast("double")), key, "label", k, "fold")
    rows = cut_lineage(rows.select("label", "fold", *features))
    pipeline = Pipeline(stages=_assemble(features, kind == "lr") + [model_for(kind)])
    with dealt(rows) as held:  # one fit after the other, as each fills the memory; no model of all rows is asked for
        fold = F.col("fold")
        found = [_weighted_f1().evaluate(pipeline.fit(held.where(fold != i)).transform(held.where(fold == i))) for i in range(k)]
    return df.sparkSession.createDataFrame([(kind, k, sum(found) / k)], "model string, folds int, weighted_f1 double")


def importances(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Random forest importances by feature."""
    rows = cut_lineage(df.select(F.col(label).cast("double").alias("label"), *features))
    with dealt(rows) as held:
        fitted = Pipeline(stages=_assemble(features, False) + [model_for("rf")]).fit(held)
    values = fitted.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def train_and_test(df: DataFrame, features: list[str], label: str, kind: str, key: str, test_fraction: float = 0.33) -> DataFrame:
    """AUC, Gini and weighted F1 on train and test rows."""
    rows = ranking.split(df.withColumn("label", F.col(label).cast("double")), key, test_fraction)
    rows = cut_lineage(rows.select("label", "split", *features))
    with dealt(rows) as held:
        fitted = Pipeline(stages=_assemble(features, kind == "lr") + [model_for(kind)]).fit(held.where("split = 'train'"))
    scored = cut_lineage(fitted.transform(rows).select(
        "split", "label", "prediction", vector_to_array("probability")[1].alias("score")
    ))
    parts = []
    for part in ("train", "test"):
        some = scored.where(F.col("split") == part)
        auc = agg.auc_gini(some, "label", "score")
        f1 = agg.weighted_f1(some, "label", "prediction")
        parts.append(auc.withColumns({"weighted_f1": f1.scalar(), "split": F.lit(part), "model": F.lit(kind)}))
    return parts[0].unionByName(parts[1])


# Trials and ranges of the studied searches, said in the models' own parameters. The smallest node
# that may be split and penalties inside boosting have no counterpart here.
TRIALS = {"lr": 100, "rf": 100, "gbt": 200}


def draw_settings(kind: str, trials: int, seed: int = SEED) -> list[dict]:
    """Repeatable random settings from the search space of one kind of model."""
    rng = random.Random(f"{kind}-{seed}")
    whole = lambda lo, hi: rng.randint(lo, hi)
    spaces = {
        # The penalty is one over C, which is drawn on a logarithmic scale.
        "lr": lambda: {"regParam": 1 / 10 ** rng.uniform(-2, 0), "tol": rng.uniform(1e-6, 1e-3)},
        "rf": lambda: {"numTrees": whole(5, 200), "maxDepth": whole(3, 30), "minInstancesPerNode": whole(3, 10)},
        "gbt": lambda: {
            "maxDepth": max(1, math.ceil(math.log2(whole(2, 256)))), "minInstancesPerNode": whole(1, 100),
            "subsamplingRate": rng.uniform(0.4, 1.0), "featureSubsetStrategy": str(round(rng.uniform(0.4, 1.0), 3)),
        },
    }
    return [spaces[kind]() for _ in range(trials)]


def search(
    df: DataFrame, features: list[str], label: str, kind: str, key: str, trials: int | None = None, parallelism: int = 4
) -> DataFrame:
    """Validation F1 of every drawn setting; the best is fitted again and scored on held-out rows.

    A third of the rows is held out and a fifth of the rest validates, both by
    exact splits on `key`, so the rows do not depend on how they are stored.
    """
    rows = ranking.split(df.withColumn("label", F.col(label).cast("double")), key, 0.33)
    inner = ranking.split(rows.where("split = 'train'").withColumn("_key", F.concat(F.lit("v|"), F.col(key))), "_key", 0.2, out="part")
    inner = cut_lineage(inner.select("label", "part", *features))
    test = cut_lineage(rows.where("split = 'test'").select("label", *features))
    pipeline = lambda setting: Pipeline(stages=_assemble(features, kind == "lr") + [model_for(kind, **setting)])
    settings = draw_settings(kind, trials or TRIALS[kind])
    with dealt(inner) as held:
        train, valid = held.where("part = 'train'"), held.where("part = 'test'")

        def score(setting: dict) -> float:
            return _weighted_f1().evaluate(pipeline(setting).fit(train).transform(valid))

        with ThreadPool(min(parallelism, len(settings))) as pool:
            found = pool.map(inheritable_thread_target(df.sparkSession)(score), settings)
        best = max(range(len(settings)), key=lambda i: found[i])
        final = _weighted_f1().evaluate(pipeline(settings[best]).fit(held).transform(test))
    made = [
        (kind, ", ".join(f"{k}={v}" for k, v in sorted(s.items())), float(m), i == best, float(final) if i == best else None)
        for i, (s, m) in enumerate(zip(settings, found))
    ]
    return df.sparkSession.createDataFrame(
        made, "model string, params string, weighted_f1 double, best boolean, test_weighted_f1 double"
    )


# -- text ---------------------------------------------------------------------


CONFUSION = ("_n", "_tp", "_fp", "_fn", "_same")

# The usual stop of such fits: a step that improves the loss by less than this share of it.
TOLERANCE = 1e-4


def text_pipeline(kind: str, words_kept: int = 1 << 18, least_texts: int = 2) -> Pipeline:
    """TF-IDF over a fitted vocabulary and a linear model.

    The vocabulary holds the most frequent words, `words_kept` at most, that stand
    in `least_texts` training texts or more: no two words share a place, and what
    an optimiser step sends to the driver is as wide as the vocabulary, not as a
    table of hashes.
    """
    model = {
        "lr": lambda: LogisticRegression(regParam=0.01, maxIter=100, tol=TOLERANCE),
        "svm": lambda: LinearSVC(regParam=0.01, maxIter=100, tol=TOLERANCE),
        "multinomial": lambda: LogisticRegression(regParam=0.01, maxIter=100, tol=TOLERANCE, family="multinomial"),
    }[kind]()
    return Pipeline(stages=[
        CountVectorizer(inputCol="words", outputCol="tf", vocabSize=words_kept, minDF=float(least_texts)),
        IDF(inputCol="tf", outputCol="features"),
        model,
    ])


def with_words(df: DataFrame, text: str, label: str) -> DataFrame:
    return df.withColumns({"words": words(F.coalesce(F.col(text), F.lit(""))), "label": F.col(label).cast("double")})


def fold_parts(train: DataFrame, test: DataFrame, key: str, holdout: float = 0.1) -> DataFrame:
    """`words`, `label` and `split` of a fold: train and test (the stratified hold-out) of `train`, and `test` as final."""
    held = ranking.split(train, key, holdout, "label").select("words", "label", "split")
    return held.unionByName(test.select("words", "label", F.lit("final").alias("split")))


def fold_sizes(parts: DataFrame) -> DataFrame:
    """One row: train_samples, eval_samples and test_samples of a fold."""
    names = (("train", "train_samples"), ("test", "eval_samples"), ("final", "test_samples"))
    return parts.agg(*[F.count(F.when(F.col("split") == s, 1)).alias(n) for s, n in names])


def fit_fold(train: DataFrame, key: str, kind: str = "lr", holdout: float = 0.1) -> tuple[DataFrame, PipelineModel]:
    """Trained on what the stratified hold-out leaves: `train` scored (split, label, prediction), and the model."""
    held = cut_lineage(ranking.split(train, key, holdout, "label").select("words", "label", "split"))
    fitted = text_pipeline(kind).fit(held.where("split = 'train'"))
    return cut_lineage(fitted.transform(held).select("split", "label", "prediction")), fitted


def score_fold(held: DataFrame, fitted: PipelineModel, test: DataFrame) -> DataFrame:
    """One row: sizes, accuracy and F1 of a fitted fold on its hold-out and on the test rows."""
    final = fitted.transform(test.select("words", "label")).select(F.lit("final").alias("split"), "label", "prediction")
    scored = held.unionByName(cut_lineage(final))
    sizes = fold_sizes(scored)
    metrics = agg.binary_metrics(scored, "label", "prediction", ["split"])
    pick = lambda s, m: F.max(F.when(F.col("split") == s, F.col(m)))
    wide = metrics.agg(
        pick("test", "accuracy").alias("eval_accuracy"), pick("test", "f1").alias("eval_f1"),
        pick("final", "accuracy").alias("test_accuracy"), pick("final", "precision").alias("test_precision"),
        pick("final", "recall").alias("test_recall"), pick("final", "f1").alias("test_f1"),
    )
    row = sizes.first().asDict() | wide.first().asDict()
    schema = "train_samples bigint, eval_samples bigint, test_samples bigint, " + ", ".join(
        f"{c} double" for c in wide.columns
    )
    return held.sparkSession.createDataFrame([tuple(row.values())], schema)


def fold_metrics(train: DataFrame, test: DataFrame, key: str, kind: str = "lr", holdout: float = 0.1) -> DataFrame:
    """Train on what the stratified hold-out leaves; score the hold-out and the test rows.

    `train` and `test` carry `words` and `label`. One row: sizes, accuracy and F1.
    """
    return score_fold(*fit_fold(train, key, kind, holdout), test)


def text_baseline(df: DataFrame, text: str, label: str, key: str, kind: str, holdout: float = 0.3) -> DataFrame:
    """Hold-out metrics of a TF-IDF classifier."""
    rows = cut_lineage(ranking.split(with_words(df, text, label), key, holdout, "label").select("words", "label", "split"))
    fitted = text_pipeline(kind).fit(rows.where("split = 'train'"))
    scored = fitted.transform(rows.where("split = 'test'")).select("label", "prediction")
    return agg.binary_metrics(scored, "label", "prediction").withColumn("model", F.lit(kind))


def year_folds(df: DataFrame, folds: DataFrame, date: str):
    """(columns that name the fold, train rows, test rows) per test year: everything before it trains, the year tests."""
    for year in [r["test_year"] for r in folds.orderBy("test_year").collect()]:
        names = {"test_year": year, "description": f"all before {year}, scored on {year}"}
        yield names, df.where(F.year(date) < year), df.where(F.year(date) == year)


def domain_folds(df: DataFrame, pairs: DataFrame):
    """The same per ordered pair of domains: the first trains, the second tests."""
    trains = {}
    for r in pairs.orderBy("train_no", "test_no").collect():
        names = {c: r[c] for c in ("train_domain", "test_domain")}
        train = trains.setdefault(r["train_no"], df.where(F.col("subject").isin(r["train_subjects"])))
        yield names, train, df.where(F.col("subject").isin(r["test_subjects"]))


def validation(folds, key: str, kind: str = "lr") -> DataFrame:
    """One row of sizes and metrics per fold; folds that follow one another on the same training rows share a fit."""
    out = []
    for train, same in groupby(folds, key=lambda fold: fold[1]):
        held, fitted = fit_fold(train, key, kind)
        out += [_named(names, score_fold(held, fitted, test)) for names, _, test in same]
    return _stack(out)


def _words_scorer(kind: str, train: DataFrame):
    """What adds the predictions of a fitted text model to rows.

    Where no word stands in two texts, there is but an intercept to fit: the larger class is said, 0 on a tie.
    """
    vocabulary, *rest = text_pipeline(kind).getStages()
    known = vocabulary.fit(train)
    if known.vocabulary:
        return Pipeline(stages=[known, *rest]).fit(train).transform
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    said = 1.0 if sizes.get(1.0, 0) > sizes.get(0.0, 0) else 0.0
    return lambda rows: rows.withColumn("prediction", F.lit(said))


def domain_validation(
    df: DataFrame, domains: DataFrame, key: str, kind: str = "lr", holdout: float = 0.1, parallelism: int = 8
) -> DataFrame:
    """`validation` of every ordered pair of different domains.

    What a model says of a text does not depend on the domain that the text is tested in. So a model is fitted once for
    each set of training subjects and scores every text once; its hits and misses are counted by subject, a few rows
    for each model, and those of a test domain are added up from its subjects.
    """
    spark = df.sparkSession
    found = [(r["domain"], r["true_subject"], r["fake_subject"]) for r in domains.orderBy("domain").collect()]
    if len(found) < 2:
        raise ValueError("no fold meets the size floors")
    of = {no: tuple(sorted({t, f})) for no, t, f in found}
    sets = sorted(set(of.values()))
    some = df.where(F.col("subject").isin(sorted({s for own in sets for s in own})))
    rows = cut_lineage(some.select(key, "subject", "words", "label"))
    size = dict(rows.groupBy("subject").count().collect())

    def count(own: tuple) -> list[tuple]:
        train = ranking.split(rows.where(F.col("subject").isin(list(own))), key, holdout, "label")
        parts = -(-sum(size[s] for s in own) // TEXTS_A_TASK)
        with let_go(train.select("words", "label", "split").repartition(parts).persist()) as held:
            scored = _words_scorer(kind, held.where("split = 'train'"))
            counts = agg.confusion(scored(held), "label", "prediction", ["split"])
            counts = counts.select("split", F.lit(None).cast("string").alias("subject"), *CONFUSION)
            final = agg.confusion(scored(rows), "label", "prediction", ["subject"])
            final = final.select(F.lit("final").alias("split"), "subject", *CONFUSION)
            return [(sets.index(own), *r) for r in [*counts.collect(), *final.collect()]]

    with ThreadPool(min(parallelism, len(sets))) as pool:
        told = [r for part in pool.map(inheritable_thread_target(spark)(count), sets, chunksize=1) for r in part]
    told = spark.createDataFrame(told, f"fit int, split string, subject string, {', '.join(f'{c} bigint' for c in CONFUSION)}")
    named = [(no, f"{t} vs {f}", sets.index(of[no]), list(of[no])) for no, t, f in found]
    named = spark.createDataFrame(named, "no int, name string, fit int, subjects array<string>")

    split = lambda s: told.where(F.col("split") == s)
    fits = split("train").select("fit", F.col("_n").alias("train_samples"))
    held = agg.rates(split("test"), ["fit", "_n"]).select(
        "fit", F.col("_n").alias("eval_samples"), F.col("accuracy").alias("eval_accuracy"), F.col("f1").alias("eval_f1")
    )
    trains = named.select(F.col("no").alias("a"), F.col("name").alias("train_domain"), "fit")
    tests = named.select(F.col("no").alias("b"), F.col("name").alias("test_domain"), F.explode("subjects").alias("subject"))
    pairs = trains.join(split("final"), "fit").join(tests, "subject").where("a <> b")
    names = ["train_domain", "test_domain", "fit"]
    pairs = pairs.groupBy("a", "b", *names).agg(*[F.sum(c).alias(c) for c in CONFUSION])
    out = agg.rates(pairs, [*names, "_n"]).join(fits, "fit", "left").join(held, "fit", "left")
    return out.select(
        "train_domain", "test_domain", F.coalesce("train_samples", F.lit(0)).alias("train_samples"),
        F.coalesce("eval_samples", F.lit(0)).alias("eval_samples"), F.col("_n").alias("test_samples"), "eval_accuracy", "eval_f1",
        *[F.col(c).alias(f"test_{c}") for c in ("accuracy", "precision", "recall", "f1")],
    )


def validation_sizes(folds, key: str) -> DataFrame:
    """The sizes alone, from the parts that the models are fitted and scored on."""
    return _stack([_named(names, fold_sizes(fold_parts(train, test, key))) for names, train, test in folds])


def _named(names: dict, row: DataFrame) -> DataFrame:
    return row.select(*[F.lit(v).alias(c) for c, v in names.items()], "*")


def _stack(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("no fold meets the size floors")
    return reduce(DataFrame.unionByName, frames)


def relevance_model(texts: DataFrame, key: str) -> DataFrame:
    """Three-class model of a day's return class from its titles, classes balanced."""
    rows = ranking.balanced_sample(texts, "label", key)
    rows = cut_lineage(ranking.split(with_words(rows, "text", "label"), key, 0.3, "label").select("words", "label", "split"))
    fitted = text_pipeline("multinomial").fit(rows.where("split = 'train'"))
    scored = cut_lineage(fitted.transform(rows).select("split", "label", "prediction"))
    parts = [
        agg.weighted_f1(scored.where(F.col("split") == s), "label", "prediction").withColumn("split", F.lit(s))
        for s in ("train", "test")
    ]
    return parts[0].unionByName(parts[1])
