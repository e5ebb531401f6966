"""Connected components as DataFrame operations, for graphs that no single task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import dropped, written


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return _ordered(both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = edges.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph with the links (a long, b long).

    Returns (node, component): one row for every node that is not the least of its component, which is
    its ``component``. Alternates large-star and small-star steps until nothing moves, writing the links
    of each round to the shared folder; the links shrink to one per node and no node's links meet in one
    task but as a partial minimum or one side of a join that Spark may split. Self-links, repeated links
    and an empty table are fine; links with a null end are ignored.
    """
    state = written(_ordered(edges.where("a is not null and b is not null")))

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    seen = mark(state)
    while seen[0]:
        after = written(_small_star(_large_star(state)))
        now = mark(after)
        dropped(state)
        state = after
        if now == seen:
            break
        seen = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
