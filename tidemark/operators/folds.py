"""Train/test folds by year and by subject domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def time_folds(
    df: DataFrame, date: str = "published", min_train: int = 3000, min_test: int = 500,
    max_folds: int | None = 2, start_year: int | None = None, end_year: int | None = None,
) -> DataFrame:
    """One row per test year with everything earlier as training rows.

    Only year counts are ordered, a few rows whatever the data.
    """
    years = df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("test_year")).agg(F.count(F.lit(1)).alias("test_rows"))
    w = W.partitionBy(F.lit(0)).orderBy("test_year")
    before = F.coalesce(F.sum("test_rows").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    folds = years.withColumn("train_rows", before).where(
        (F.col("train_rows") >= min_train) & (F.col("test_rows") >= min_test)
    )
    if start_year:
        folds = folds.where(F.col("test_year") >= start_year)
    if end_year:
        folds = folds.where(F.col("test_year") <= end_year)
    folds = folds.withColumn("fold", F.row_number().over(w))
    return folds.where(F.col("fold") <= max_folds) if max_folds else folds


def top_subjects(df: DataFrame, k: int | None = 2, min_rows: int = 800) -> DataFrame:
    """The k most frequent subjects of each label among those frequent enough, or all of those."""
    counts = df.groupBy("label", "subject").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    w = W.partitionBy("label").orderBy(F.desc("n"), "subject")
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k) if k else ranked


def domains(df: DataFrame, k: int | None = 2, min_rows: int = 800) -> DataFrame:
    """(true subject, fake subject) pairs with enough articles between them, of the top k subjects a label or of all.

    Subjects are few, so they travel as two arrays in one row and are unfolded, without any join.
    """
    top = top_subjects(df, k, min_rows)
    side = lambda label: F.sort_array(F.collect_list(F.when(F.col("label") == label, F.struct("rank", "subject"))))
    pairs = top.agg(side(1).alias("t"), side(0).alias("f"))
    pairs = pairs.select(F.explode("t").alias("t"), "f").select("t", F.col("f").alias("f_all"), F.explode("f").alias("f")).select(
        F.col("t.subject").alias("true_subject"), F.col("f.subject").alias("fake_subject"),
        ((F.col("t.rank") - 1) * (F.lit(k) if k else F.size("f_all")) + F.col("f.rank")).alias("domain"),
    )
    # A row counts once per domain its subject is part of, whatever its label.
    members = pairs.select("domain", F.explode(F.array_distinct(F.array("true_subject", "fake_subject"))).alias("subject"))
    sizes = df.groupBy("subject").agg(F.count(F.lit(1)).alias("_n")).join(members, "subject")
    sizes = sizes.groupBy("domain").agg(F.sum("_n").alias("rows"))
    return pairs.join(sizes, "domain").where(F.col("rows") >= 2 * min_rows)


def domain_pairs(df: DataFrame, k: int = 2, min_rows: int = 800, max_pairs: int | None = 4) -> DataFrame:
    """Ordered (train, test) pairs of different domains, the first `max_pairs` of them."""
    found = domains(df, k, min_rows)
    name = F.concat_ws(" vs ", "true_subject", "fake_subject")
    parts = F.array("true_subject", "fake_subject").alias("subjects")
    all_ = found.agg(F.sort_array(F.collect_list(F.struct("domain", name.alias("name"), parts))).alias("d"))
    pairs = all_.select("d", F.explode("d").alias("a")).select("a", F.explode("d").alias("b"))
    pairs = pairs.where("a.domain <> b.domain").select(
        F.col("a.domain").alias("train_no"), F.col("b.domain").alias("test_no"),
        F.col("a.name").alias("train_domain"), F.col("b.name").alias("test_domain"),
        F.col("a.subjects").alias("train_subjects"), F.col("b.subjects").alias("test_subjects"),
    )
    return pairs.orderBy("train_no", "test_no").limit(max_pairs) if max_pairs else pairs
