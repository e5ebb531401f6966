"""Paired corpora, coverage of an index, and joins that must match row for row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import NUL


#: Rows whose digests are joined at once.
BLOCK = 1 << 16


def ordered_digest(rows: DataFrame, order: str, digest: str, out: str) -> DataFrame:
    """One row: the sha256 of ``digest`` joined by NUL in the order of the index ``order``.

    Of ``BLOCK`` rows at a time; an index over ``BLOCK`` gives the sha256 of the blocks' digests instead, so that no task holds all of them.
    """
    joined = lambda k, v: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(v).alias("v")))), lambda x: x["v"]), NUL), 256)
    blocks = rows.groupBy(F.floor(F.col(order) / BLOCK).alias("block")).agg(joined(order, digest).alias("own"))
    return blocks.agg(F.when(F.count("*") > 1, joined("block", "own")).otherwise(F.coalesce(F.max("own"), F.sha2(F.lit(""), 256))).alias(out))


def sequence_digest(rows: DataFrame, order: str, digest: str, out: str) -> DataFrame:
    """One row: the sha256 of every ``digest`` that is not null, joined by NUL in the order of ``order`` (null last, then by digest); of the empty string without any.

    A sha256 is sequential, so one task reads the sorted digests as a stream: 64 characters a row, a batch of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = hashlib.sha256(), True
        for batch in batches:
            found = batch.column(0).to_pylist()
            if found:
                total.update(("" if first else NUL).encode() + NUL.join(found).encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([total.hexdigest()])], [out])

    held = rows.where(F.col(digest).isNotNull()).select(F.col(order).alias("k"), F.col(digest).alias("v"))
    hashed = held.repartition(1).sortWithinPartitions(F.asc_nulls_last("k"), "v").select("v").mapInArrow(run, f"{out} string")
    return hashed.agg(F.coalesce(F.max(out), F.sha2(F.lit(""), 256)).alias(out))  # without rows no task runs


def paired_report(left: DataFrame, right: DataFrame, right_is_prefix: bool = False) -> DataFrame:
    """One row about two corpora (idx, prompt_sha, solution, response) paired by index, which counts rows from 0.

    ``problem`` is the first of these that holds, else null: invalid_prefix_sizes (the right has no rows or more) or row_count_mismatch;
    index_mismatch (an index is in one corpus only; behind the end of a right prefix that is fine); prompt_mismatches; solution_mismatches (where both
    have one); identical_responses (all are). The digest is that of the right side's prompts.
    """
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    both = left.join(r, F.col("idx") == F.col("r_idx"), "full")
    pair = F.col("idx").isNotNull() & F.col("r_idx").isNotNull()
    other_prompt = pair & ~F.col("prompt_sha").eqNullSafe(F.col("r_prompt_sha"))
    other_solution = pair & F.col("solution").isNotNull() & F.col("r_solution").isNotNull() & (F.col("solution") != F.col("r_solution"))
    same = F.col("response").eqNullSafe(F.col("r_response"))
    found = both.agg(
        F.count("idx").alias("left_rows"),
        F.count("r_idx").alias("right_rows"),
        F.count_if(pair).alias("paired"),
        F.count_if(F.col("idx").isNull()).alias("right_only"),
        F.min(F.when(F.col("r_idx").isNull(), F.col("idx"))).alias("left_only"),
        F.count_if(other_prompt).alias("prompt_mismatches"),
        F.min(F.when(other_prompt, F.col("idx"))).alias("first_prompt_mismatch"),
        F.count_if(other_solution).alias("solution_mismatches"),
        F.min(F.when(other_solution, F.col("idx"))).alias("first_solution_mismatch"),
        F.count_if(pair & same).alias("same_responses"),
        F.count_if(pair & ~same).alias("different_responses"),
    )
    n, m = F.col("left_rows"), F.col("right_rows")
    sizes = F.when((m == 0) | (n < m), "invalid_prefix_sizes") if right_is_prefix else F.when(n != m, "row_count_mismatch")
    alone = (F.col("right_only") > 0) | (F.col("left_only") < m if right_is_prefix else F.col("left_only").isNotNull())
    problem = F.coalesce(
        sizes,
        F.when(alone, "index_mismatch").when(F.col("prompt_mismatches") > 0, "prompt_mismatches").when(F.col("solution_mismatches") > 0, "solution_mismatches").when(F.col("same_responses") == m, "identical_responses"),
    )
    out = found.withColumn("problem", problem).drop("right_only", "left_only")
    return out.join(F.broadcast(sequence_digest(right, "idx", "prompt_sha", "prompts_sha256")))  # one row each


def require_paired(report: DataFrame) -> DataFrame:
    """The report, or ValueError with its counts if it names a problem."""
    row = report.first()
    if row["problem"]:
        raise ValueError(f"{row['problem']}: {', '.join(f'{k} {v}' for k, v in row.asDict().items() if k not in ('problem', 'prompts_sha256'))}")
    return report


def coverage(rows: DataFrame, index: str, expected: int) -> DataFrame:
    """(kind, n, examples) for missing, unexpected and repeated indices of 0..expected-1; the first ten of each."""
    spark = rows.sparkSession
    have = rows.select(F.col(index).cast("long").alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    want = spark.range(expected).select(F.col("id").alias("i"))
    kinds = {
        "missing": want.join(have, "i", "left_anti").select("i"),
        "unexpected": have.where(F.col("i").isNull() | (F.col("i") < 0) | (F.col("i") >= expected)).select("i"),
        "repeated": have.where("n > 1").select("i"),
    }
    out = None
    for kind, found in kinds.items():
        ten = found.orderBy("i").limit(10).agg(F.array_join(F.array_sort(F.collect_list("i")).cast("array<string>"), ",").alias("examples"))
        row = found.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")).join(F.broadcast(ten))  # one row each
        out = row if out is None else out.unionAll(row)
    return out


def last_wins(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row"))
    return last.select(key, *(F.col(f"row.{c}").alias(c) for c in columns))


def grid(rows: DataFrame, keys: list[tuple[str, list]], value: str) -> DataFrame:
    """Every cell of a small grid of given values, with ``value`` or null and whether it is there."""
    spark, cells = rows.sparkSession, [()]
    for _, values in keys:
        cells = [(*c, v) for c in cells for v in values]
    names = [k for k, _ in keys]
    full = spark.createDataFrame(cells, rows.select(*names).schema)
    return full.join(rows.select(*names, value), names, "left").withColumn("present", F.col(value).isNotNull())
