"""Appending to a table batch by batch, each once: a batch owns the partition of its number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_batches(stream: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], schema: str, target: str, checkpoint: str, parts: tuple[str, ...] = (), wrote: Callable[[SparkSession, int], None] | None = None, mode: str = "append") -> StreamingQuery:
    """Start a query that takes all there is of ``stream`` now and writes what ``make(batch, before)`` returns.

    ``schema`` names the table's columns with ``batch long``, its first partition; ``parts`` are further ones. ``before`` is what batches of lower
    numbers wrote. A batch replaces its own partition, so one that is run again after a stop (the checkpoint hands it the same rows) leaves
    the same rows once. ``wrote`` is called after a batch was written.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = make(batch, table(spark, schema, target, number)).withColumn("batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *parts).parquet(target)
        if wrote:
            wrote(spark, number)

    return stream.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, schema: str, target: str, below: int | None = None) -> DataFrame:
    """The table, or what the batches of numbers under ``below`` wrote; before batch 0 nothing was, and nothing is read."""
    if below == 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(target)
    return rows if below is None else rows.where(F.col("batch") < below)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key no row of ``done`` has; a null key is always pending."""
    return rows.join(done.select(F.col(key).alias("_done")).distinct(), F.col(key) == F.col("_done"), "left_anti")
