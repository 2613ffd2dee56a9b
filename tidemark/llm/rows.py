"""Small helpers of the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet")


def whole_text(df: DataFrame) -> DataFrame:
    """doc_id and text, a missing text being empty. Other columns are left behind."""
    return df.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def task_number() -> int:
    """The number of this partition: the same again when a lost task is repeated."""
    return TaskContext.get().partitionId()


def small_batches(batches: Iterator[pa.RecordBatch], bytes_at_once: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded size (or of one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, batch.num_rows * bytes_at_once // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def by_batch(fn: Callable[[dict], dict], schema: pa.Schema) -> Callable:
    """A mapInArrow function from one that turns columns as lists into columns."""

    def run(batches):
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_pydict(fn(batch.to_pydict()), schema=schema)

    return run
