"""JSON lines, shards and checkpoints: scans, repair of torn tails, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Lines as rows; blank lines are skipped, and malformed ones raise unless ``strict`` is False."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "PERMISSIVE")


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a row; Spark's committer makes the files appear whole or not at all."""
    df.write.mode(mode).json(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, at, line): the lines of text files, which Spark reads by byte ranges; ``at`` counts on through a block."""
    place = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "file"), ("file_block_start", "block"), ("file_size", "size"))]
    return spark.read.option("lineSep", "\n").text(path).select(*place, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str, torn: bool = True) -> DataFrame:
    """(file, line_no, line) of the lines that are not blank; ``line_no`` counts all lines of a file, from 0.

    A file of any size is read by byte ranges in many tasks. Each range's lines are counted, a prefix sum over the ranges of
    a file gives each its first number, and rows are not shuffled for it. With ``torn`` False the last line of a file
    goes unless it ends with a line end: the lines' bytes tell, since such a file is one byte short (not of compressed files,
    whose last line stays).
    """
    rows = _placed(spark, path)
    ranges = rows.groupBy("file", "block", "size").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    own = Window.partitionBy("file")
    before = F.sum("n").over(own.orderBy("block")) - F.col("n")
    cut = F.sum("bytes").over(own) == F.col("size") + 1
    ranges = ranges.select("file", "block", (before - F.col("first")).alias("shift"), F.when(cut, F.sum("n").over(own) - 1).alias("torn"))
    out = rows.join(ranges, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "line", "torn")
    if not torn:  # made null, not only left out: conditions on lines are then not pushed below the join, where torn ones still are
        out = out.withColumn("line", F.when(F.col("torn").isNull() | (F.col("line_no") != F.col("torn")), F.col("line")))
    return out.where(F.col("line").rlike(r"\S")).drop("torn")


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, line) of the lines that are not blank, numbered from 0 in the order of files, then lines.

    As ``numbered_lines``; one count for each byte range passes through the driver.
    """
    rows = _placed(spark, path).where(F.col("line").rlike(r"\S")).drop("at").withColumn("at", F.monotonically_increasing_id())
    counts = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("file", "block").collect()
    shifts, total = [], 0
    for r in counts:
        shifts.append((r["file"], r["block"], total - r["first"]))
        total += r["n"]
    shifts = spark.createDataFrame(shifts, "file string, block long, shift long")
    return rows.join(F.broadcast(shifts), ["file", "block"]).select((F.col("at") + F.col("shift")).alias("idx"), "line")  # a row for each range


def valid_prefix(lines: DataFrame, schema: str, group: str = "file", order: str = "line_no", text: str = "line") -> DataFrame:
    """Lines before the first of their file that is torn, parsed as ``row``.

    A line is torn if it is not JSON, no object, or lacks a field of ``schema`` or has none of its type there.
    """
    parsed = lines.withColumn("row", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    fields = [F.col(f"row.{f}").isNull() for f in parsed.schema["row"].dataType.names]
    bad = F.try_parse_json(text).isNull() | ~F.trim(text).startswith("{") | F.col("row").isNull()
    for missing in fields:
        bad = bad | missing
    first_bad = F.min(F.when(bad, F.col(order))).over(Window.partitionBy(group))
    return parsed.withColumn("first_bad", first_bad).where(F.col("first_bad").isNull() | (F.col(order) < F.col("first_bad"))).drop("first_bad")


def merged_shards(rows: DataFrame, index: str = "index") -> DataFrame:
    """Shard rows by index; raises when the result is read if an index comes twice."""
    n = F.count("*").over(Window.partitionBy(index))
    return rows.withColumn("n", n).withColumn(index, F.when(F.col("n") > 1, F.raise_error(F.lit("duplicate index"))).otherwise(F.col(index))).drop("n").orderBy(index)
