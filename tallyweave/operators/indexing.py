"""Row indices, keyed permutations and percentiles of tables that no task and no driver can hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.session import new_path


def with_row_index(rows: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """``rows`` with ``out``, their place from 0 on by the columns ``order``; places of rows that are equal there are any.

    Rows are dealt into sorted ranges and written to the shared folder once; the ranges are counted, a prefix sum over them gives each
    its first place, and that is added row by row. What passes through the driver is a count for each range. Keys with many
    equal rows should have a further column in ``order``, since equal keys share a range.
    """
    spark, path, at = rows.sparkSession, new_path(rows.sparkSession, "row-index"), "_at"
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    sorted_.write.parquet(path)
    table = spark.read.schema(sorted_.schema).parquet(path)
    part = F.shiftrightunsigned(at, 33)
    shifts, total = [], 0
    for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(at).alias("first")).orderBy("part").collect():
        shifts.append((r["part"], total - r["first"]))
        total += r["n"]
    shifts = spark.createDataFrame(shifts, "_part long, _shift long")
    placed = table.join(F.broadcast(shifts), part == F.col("_part"))  # a row for each range
    return placed.select(*rows.columns, (F.col(at) + F.col("_shift")).alias(out))


#: Rounds of a permutation's network.
ROUNDS = 4


def permuted_index(idx: Column, n: int, seed: int) -> Column:
    """A keyed permutation of 0..n-1 as a column: every place comes once, and nothing is shuffled or collected.

    A Feistel network over pairs (idx mod a, idx div a) with a * b places for the least a, b near the root of n. A place of n or
    more is put through the network again until it is below; fewer than a are not, so that few rows take a second turn. An index outside 0..n-1 gives null.
    """
    a = max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
    b = max(1, -(-n // a))

    def turn(x: Column) -> Column:
        def one(s: Column, j: Column) -> Column:
            key = F.concat_ws(":", F.lit(str(seed)), j.cast("string"), s["r"].cast("string"))
            said = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
            return F.struct(s["r"].alias("l"), ((s["l"] + said) % F.when(j % 2 == 1, F.lit(a)).otherwise(F.lit(b)).cast("long")).alias("r"))

        start = F.struct((x % a).cast("long").alias("l"), F.floor(x / a).cast("long").alias("r"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one)
        return end["r"] * a + end["l"]

    # a cycle has fewer than a places outside; beyond small tables so many turns in a row do not happen
    turns = F.sequence(F.lit(1), F.lit(min(a, 40) + 1))
    walked = F.aggregate(turns, turn(idx.cast("long")), lambda x, _: F.when(x < n, x).otherwise(turn(x)))
    walked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no place found")).cast("long"))
    return F.when((idx >= 0) & (idx < n), walked)


#: Ranges of values that are summed up before one of them is looked into.
RANGES = 1024


def exact_percentiles(rows: DataFrame, group: str, value: str, fractions: list[float]) -> DataFrame:
    """(group, fraction, nearest_rank, linear) of an integer column, exact; nulls are left out.

    nearest_rank is the value at place (n - 1) * fraction, rounded half to even; linear lies between the values around that place.
    Rows are counted by value before they meet, values by range; only the values of the ranges that hold a wanted place are put in
    order, within the range. A range has at most a ``RANGES``-th of all values that can be.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    spread = counts.groupBy("g").agg(F.min("v").alias("low"), (F.floor((F.max("v") - F.min("v")) / RANGES) + 1).alias("width"), F.sum("n").alias("all"))
    same = F.col("g").eqNullSafe(F.col("s_g"))
    placed = counts.join(spread.withColumnRenamed("g", "s_g"), same).select("g", "v", "n", "all", F.floor((F.col("v") - F.col("low")) / F.col("width")).alias("range"))
    sums = placed.groupBy("g", "range").agg(F.sum("n").alias("own"), F.max("all").alias("all"))
    sums = sums.withColumn("before", F.sum("own").over(Window.partitionBy("g").orderBy("range")) - F.col("own"))
    at = lambda f: (F.col("all") - 1) * F.lit(float(f))
    wanted = F.explode(F.array(*(F.struct(F.lit(float(f)).alias("fraction"), kind.cast("long").alias("place"), F.lit(name).alias("kind")) for f in fractions for name, kind in (("near", F.bround(at(f))), ("low", F.floor(at(f))), ("high", F.ceil(at(f)))))))
    held = sums.select(F.col("g").alias("s_g"), F.col("range").alias("s_range"), "all", "before", "own", wanted.alias("w")).where((F.col("w.place") >= F.col("before")) & (F.col("w.place") < F.col("before") + F.col("own")))
    inside = placed.select("g", "range", "v", "n").join(held.select("s_g", "s_range", "before").distinct(), same & (F.col("range") == F.col("s_range")))
    first = F.sum("n").over(Window.partitionBy("g", "range").orderBy("v")) - F.col("n") + F.col("before")
    inside = inside.select("g", "range", "v", "n", first.alias("first"))
    hit = inside.join(held.drop("before", "own"), same & (F.col("range") == F.col("s_range")) & (F.col("w.place") >= F.col("first")) & (F.col("w.place") < F.col("first") + F.col("n")))
    of = lambda kind: F.max(F.when(F.col("w.kind") == kind, F.col("v")))
    found = hit.groupBy("g", "w.fraction").agg(of("near").alias("nearest_rank"), of("low").alias("low"), of("high").alias("high"), F.max("all").alias("all"))
    part = (F.col("all") - 1) * F.col("fraction")
    linear = F.col("low") + (F.col("high") - F.col("low")) * (part - F.floor(part))
    return found.select(F.col("g").alias(group), "fraction", "nearest_rank", linear.alias("linear"))
