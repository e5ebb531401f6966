"""Scans of trace files: validation in scan order, shards, providers, length hints, metric directories and repair.

A limit counts rows in the order of files, blocks and lines. Rows that break a rule raise when they are read; what lies
behind a limit is not looked at.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import names, text
from tallyweave.operators.traces import CHOICES, MESSAGES, blank, require
from tallyweave.sources.jsonl import indexed_lines, numbered_lines

PLACE = ("file", "block", "line_no")


def scanned(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """(file, block, line_no, row): the lines that are not blank as objects of ``schema``, the first ``limit`` (0: all).

    Files may be of any size; ``line_no`` only orders the lines of a block. A line that is no object raises.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), "value")
    lines = lines.where(F.trim("value") != "")
    if limit and limit > 0:
        lines = lines.orderBy(*PLACE).limit(limit)
    return _objects(lines, "value", schema)


def _is_object(line: Column) -> Column:
    return F.trim(line).startswith("{") & F.trim(line).endswith("}")


def _objects(lines: DataFrame, line: str, schema: str) -> DataFrame:
    lines = require(lines, _is_object(F.col(line)), F.concat(F.lit("not a JSON object: "), F.left(line, F.lit(80))))
    return lines.withColumn("row", F.from_json(line, schema, {"mode": "FAILFAST"})).drop(line)


def validated_traces(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(prompt, response, messages) of traces that have a response and a prompt or messages."""
    rows = scanned(spark, path, f"prompt string, response string, messages {MESSAGES}", limit).select(*PLACE, "row.*")
    rows = require(rows, ~blank(F.col("response")), "a trace has no response")
    return require(rows, (F.coalesce("prompt", F.lit("")) != "") | (F.coalesce(F.size("messages"), F.lit(0)) > 0), "a trace has neither prompt nor messages")


def read_shards(spark: SparkSession, folder: str, schema: str, limit: int | None = None, pattern: str = "rank_*.jsonl") -> DataFrame:
    """Rows of the shards in ``folder``, without a last line that has no line end.

    By index if every row has an integer one, which then must differ; else in the order of files and lines.
    A shard of any size is read by byte ranges.
    """
    rows = _objects(numbered_lines(spark, f"{folder}/{pattern}", torn=False), "line", schema).select("file", "line_no", "row.*")
    n, whole_ints, different = rows.agg(F.count("*"), F.count("index"), F.countDistinct("index")).first()
    if n and n == whole_ints:
        if different < n:
            raise ValueError(f"duplicate indices in {folder}")
        rows = rows.orderBy("index")
    else:
        rows = rows.orderBy("file", "line_no")
    rows = rows.limit(limit) if limit and limit > 0 else rows
    return rows.drop("file", "line_no")


def repaired(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of a checkpoint (file, line_no, line): up to the first line that is no JSON, without those that are no objects, have no integer index or one seen before."""
    checked = lines.withColumn("any", F.try_parse_json("line"))
    first_bad = F.min(F.when(F.col("any").isNull(), F.col("line_no"))).over(Window.partitionBy("file"))
    kept = checked.withColumn("bad", first_bad).where((F.col("bad").isNull() | (F.col("line_no") < F.col("bad"))) & _is_object(F.col("line")))
    kept = kept.where(F.schema_of_variant(F.try_variant_get("any", "$.index", "variant")) == "BIGINT")
    kept = kept.select("file", "line_no", F.from_json("line", schema).alias("row"))
    first = Window.partitionBy("file", F.col("row.index")).orderBy("line_no")
    return kept.withColumn("n", F.row_number().over(first)).where("n = 1").select("file", "line_no", "row.*")


def length_hints(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """(idx, length): lengths of the responses of a completed file, ``expected`` of them."""
    rows = _objects(indexed_lines(spark, path), "line", "response string").select("idx", "row.response")
    rows = require(rows, F.col("response").isNotNull(), "a row has no response")
    if (n := rows.count()) != expected:
        raise ValueError(f"{n} rows with lengths, expected {expected}")
    return rows.select("idx", F.length("response").alias("length"))


def by_length(rows: DataFrame, hints: DataFrame) -> DataFrame:
    """``rows`` (idx, ...) by the length hinted for them, then index."""
    return rows.join(hints, "idx").orderBy("length", "idx")


def science_examples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(prompt, solution) of prepared multiple-choice rows: first a user's, last an assistant's message; the recorded choice wins over the boxed one."""
    rows = scanned(spark, path, f"messages {MESSAGES}, _meta struct<gold_choice: string>", limit).select(*PLACE, "row.*")
    first, last = F.get("messages", F.lit(0)), F.try_element_at("messages", F.lit(-1))
    rows = require(rows, F.size("messages") >= 2, "invalid messages")
    rows = require(rows, (first["role"] == "user") & (last["role"] == "assistant"), "not a user/assistant example")
    rows = require(rows, ~blank(first["content"]) & ~blank(last["content"]), "empty content")
    known = F.upper(text.strip(F.coalesce("_meta.gold_choice", F.lit(""))))
    rows = rows.withColumn("choice", F.when(known.isin(*CHOICES), known).otherwise(text.boxed_choice(last["content"])))
    rows = require(rows, F.col("choice").isNotNull(), "no boxed choice")
    return rows.select(text.strip(first["content"]).alias("prompt"), F.concat(F.lit("\\boxed{"), "choice", F.lit("}")).alias("solution"))


def choice_rows(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(messages) of evaluation rows: two messages or more, the last an assistant's."""
    rows = scanned(spark, path, f"messages {MESSAGES}", limit).select(*PLACE, "row.messages")
    rows = require(rows, F.size("messages") >= 2, "invalid messages")
    return require(rows, F.try_element_at("messages", F.lit(-1))["role"] == "assistant", "no assistant message at the end")


def question_examples(rows: DataFrame, limit: int | None = None, order: str | None = None) -> DataFrame:
    """(prompt, solution) of questions and answers, stripped; the first ``limit`` in the order of a column."""
    if limit is not None:
        rows = (rows.orderBy(order) if order else rows).limit(limit)
    return rows.select(text.strip(F.col("question")).alias("prompt"), text.strip(F.col("answer")).alias("solution"))


def message_examples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(messages) of the first ``limit`` rows, without those that have none."""
    return scanned(spark, path, f"messages {MESSAGES}", limit).select(*PLACE, "row.messages").where(F.size("messages") > 0)


#: Providers of examples by name.
PROVIDERS: dict[str, Callable] = {"science": science_examples, "oasst1": message_examples, "gsm8k": lambda spark, path, limit=None: question_examples(scanned(spark, path, "question string, answer string", limit).select("row.*"))}


def examples(spark: SparkSession, provider: str, path: str, limit: int | None = None) -> DataFrame:
    if provider not in PROVIDERS:
        raise ValueError(f"no provider {provider!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[provider](spark, path, limit)


def permuted(rows: DataFrame, pos: str, seed: int, most: int = 5_000_000) -> DataFrame:
    """``rows`` with ``scan_pos``, their place after a seeded shuffle of 0..n-1, the values of ``pos``; over ``most`` rows raise, as the places come from the driver."""
    if (n := rows.count()) > most:
        raise ValueError(f"{n} rows; give the scan order as a column")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    places = rows.sparkSession.createDataFrame(list(zip(order, range(n))), "p_pos long, scan_pos long")
    return rows.join(places, F.col(pos) == F.col("p_pos")).drop("p_pos")


def metric_files(spark: SparkSession, folder: str, variant: str, student: str | None = None, lr: str | None = None, epochs: str | None = None) -> DataFrame:
    """(student, method, lr, epochs, metric json, teacher json) of the metrics in an experiment's folder whose names can be read and that have a teacher's evaluation."""
    kind = "alternative_traces" if variant.endswith("_unsupervised") else "training_traces"
    part = lambda c, back: F.try_element_at(F.split(c, "/"), F.lit(-back))
    read = lambda glob: spark.read.text(glob, wholetext=True).select(part(F.input_file_name(), 2).alias("name"), F.col("value"))
    metrics = read(f"{folder}/metrics/*/watermark_{variant}.json").withColumn("p", names.metrics_dir_parts(F.col("name"))).where("p.student is not null")
    for column, wanted in (("student", student), ("lr", lr), ("epochs", epochs)):
        if wanted:
            metrics = metrics.where(F.col(f"p.{column}") == str(wanted))
    teachers = read(f"{folder}/{kind}/*/teacher_eval.json").select(F.col("name").alias("method"), F.col("value").alias("teacher"))
    return metrics.select("p.*", F.col("value").alias("metric")).join(teachers, "method")


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the parts ``rank_*/part_*`` with the path that orders them."""
    return spark.read.parquet(f"{folder}/rank_*/part_*").withColumn("part", F.col("_metadata.file_path"))
