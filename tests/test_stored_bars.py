"""Bars stored once, and joins that leave a symbol's rows where they lie."""

import time

from conftest import SF, rows
from pyspark.sql import Window as W, functions as F

from tidemark.plans import study
from tidemark.session import cut_lineage, lying_together
from tidemark.sources.tables import Tables


def test_views_of_stored_bars_are_the_same(spark, tables):
    stored = tables.with_stored_bars()
    assert rows(stored.vix, "date") == rows(tables.vix, "date")
    assert rows(stored.releases, "symbol", "date") == rows(tables.releases, "symbol", "date")


def test_both_panels_read_one_stage(spark):
    t = Tables(spark, SF)
    assert study.stock(t) is study.stock(t)


def test_rows_of_a_symbol_are_not_shuffled_again(spark, tables):
    first = W.partitionBy("symbol").orderBy("date")
    left = cut_lineage(tables.bars).withColumn("place", F.row_number().over(first))
    right = cut_lineage(tables.bars.select("symbol", "date", F.col("close").alias("other")))
    joined = left.join(right.hint("merge"), ["symbol", "date"], "left")
    plan = lambda: joined.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    apart = plan()
    with lying_together(spark):
        together = plan()
    assert (apart, together) == (3, 2)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_stages_are_stored_small(spark):
    from tidemark.session import cut_lineage

    assert all(".zstd." in f for f in cut_lineage(spark.range(10)).inputFiles())


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _left_by(spark, work):
    """Shuffle files that are there some seconds after `work` and were not before."""
    before = _shuffle_files(spark)
    work()
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_stages_leave_no_shuffle_files(spark):
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert _left_by(spark, lambda: cut_lineage(counts)) == set()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_stages_hold_their_rows_when_what_they_read_was_let_go(spark):
    """A frame is planned anew for each write, also when it has been written before."""
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    first, again = cut_lineage(counts), cut_lineage(counts)
    assert rows(first, "k") == rows(again, "k") == rows(counts, "k")


def test_both_panels_read_one_stage_of_news(spark):
    t = Tables(spark, SF)
    assert study.stored_news(t) is study.stored_news(t)
    assert rows(study.stored_news(t), "company", "date") == rows(study.daily_news(t), "company", "date")
