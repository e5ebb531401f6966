"""Streaming forms of first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators.tokens import first_occurrence
from tallyweave.streaming.sink import append_batches, table


def first_seen(stream: DataFrame, keys: list[str], time: str, keep: str = "1 day") -> DataFrame:
    """Rows of a stream whose keys have not been seen within ``keep``; works on batches alike."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark(keys)


def _schema(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", batch long"


def first_by_order(stream: DataFrame, keys: list[str], order: str, values: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Keep the first row of each key by the column ``order``, whatever the order rows arrive in.

    The state holds one row a key, which is replaced when a smaller order comes. What a batch changed goes to ``target`` under the batch's number, once;
    ``first_table`` has the state as of the last batch. State and output grow with the number of different keys. Ties keep any of the tied rows.
    """
    best = stream.groupBy(*keys).agg(F.min(order).alias(order), *(F.min_by(v, order).alias(v) for v in values))
    columns = [*keys, order, *values]
    return append_batches(best.select(*columns), lambda batch, before: batch, _schema(stream, columns), target, checkpoint, mode="update")


def first_table(spark: SparkSession, like: DataFrame, keys: list[str], order: str, values: list[str], target: str) -> DataFrame:
    """The first row of each key of what ``first_by_order`` wrote; ``like`` has the columns' types."""
    columns = [*keys, order, *values]
    rows = table(spark, _schema(like, columns), target)
    return first_occurrence(rows, keys, [order], [order, *values]).select(*columns)
