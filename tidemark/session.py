"""Session settings, the shared working folder, and sides of known size."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# Settings the operators rely on. The zone fixes what a day is; the adaptive
# settings let Spark split a join partition that one hot key has filled.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and timing; on a cluster the session is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a plain local session may fall back to a temporary folder: on a
    cluster a machine-local path would be lost with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, so that runs never meet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store `df` as a table in the shared folder and go on from there.

    A lost executor then costs no earlier rounds, and later steps read only
    the columns they need, with sizes Spark knows.
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    with letting_go(spark):
        df.write.parquet(path, compression="zstd")  # stages are the larger part of what a query writes
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def letting_go(spark: SparkSession):
    """Writes inside leave no shuffle files behind: Spark removes a write's own at its end.

    A write is planned anew each time, so nothing later reads them; else they would lie there until the
    driver's collector comes to them, and a query's disk would be the sum of its steps.
    """
    with _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


_lock = threading.Lock()
_holders: dict[str, list] = {}


@contextmanager
def _held(spark: SparkSession, key: str, value: str):
    """A setting for as long as some thread needs it; the last one puts back what the first one found."""
    with _lock:
        here = _holders.setdefault(key, [0, None])
        if not here[0]:
            here[1] = spark.conf.get(key, None)
            spark.conf.set(key, value)
        here[0] += 1
    try:
        yield
    finally:
        with _lock:
            here[0] -= 1
            if not here[0] and here[1] is None:
                spark.conf.unset(key)
            elif not here[0]:
                spark.conf.set(key, here[1])


@contextmanager
def lying_together(spark: SparkSession):
    """Joins stored inside take rows that lie together by some of their keys as they lie, and shuffle the other side alone.

    For joins by symbol and date after a step by symbol: a symbol has one row per day, which bounds the group.
    """
    with _held(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        yield


def sized(df: DataFrame) -> DataFrame:
    """The rows, stored, so that Spark knows their bytes and its own threshold decides on a broadcast.

    Beyond the threshold Spark joins by shuffle, and the adaptive skew rule
    splits the hot keys.
    """
    return cut_lineage(df)


def broadcast_days(df: DataFrame) -> DataFrame:
    """Broadcast a series that holds one row per calendar day.

    The calendar is the bound: 366 rows a year, whatever the size of the data
    the series was computed from.
    """
    return F.broadcast(df)
