"""Streams of news rows: ingest, first-seen filter and daily sums.

Sinks are keyed by batch, so a batch that runs twice after a failure is written
once. What has to be remembered is the written result itself: no watermark drops a
late row, and no time limit forgets a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def read_table(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Rows of a Parquet table, one file or a folder in which files arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern the path may be a file as well.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def _batch_writer(path: str):
    def write(batch: DataFrame, number: int) -> None:
        # A repeated batch replaces itself.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every arriving row once, and stop when the folder is drained."""
    return _each_batch(stream, _batch_writer(path), checkpoint)


def _earlier(spark: SparkSession, path: str, number: int, schema) -> DataFrame:
    """What the batches before `number` have written; nothing of a batch that is being repeated."""
    if number == 0:
        return spark.createDataFrame([], schema)
    kept = [*schema.fields, StructField("batch", LongType())]
    return spark.read.schema(StructType(kept)).option("ignoreMissingFiles", "true").parquet(path).where(F.col("batch") < number)


def first_seen(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """The first row of every key, whenever the key comes again: no time limit, no state to lose.

    The result is its own memory: a batch keeps its first row per key in `order`,
    leaves out keys that earlier batches have written, of which only the key columns
    are read, and writes a folder of its own. A repeated batch sees what it saw
    before and replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        columns = batch.columns
        first = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_f")
        new = batch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first).select(*[F.col("_f")[c].alias(c) for c in columns])
        known = _earlier(batch.sparkSession, path, number, batch.schema).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        new.join(known, same, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _each_batch(stream, write, checkpoint)


def daily_sums(stream: DataFrame, key: str, time: str, columns: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Sums by key and day, as rows arrive, however late; read them with `totals`.

    A batch adds up its own rows and writes one row per key and day into a folder of
    its own, which a repeated batch replaces. Nothing waits for a watermark, so the
    last days are there as well.
    """

    def write(batch: DataFrame, number: int) -> None:
        day = F.to_date(time).alias("date")
        sums = batch.groupBy(key, day).agg(*[F.sum(c).alias(c) for c in columns])
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _each_batch(stream, write, checkpoint)


def totals(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """The daily sums so far: one row per key and day over all batches."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key, "date").agg(*[F.sum(c).alias(c) for c in columns])


def _each_batch(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
