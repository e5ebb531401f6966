"""Intake of traces, incremental: takes files that are new, decides on each trace, appends the decisions.

    python -m jobs.trace_intake SOURCE TARGET CHECKPOINT CONFIG

SOURCE is a Parquet folder (or file) that grows by whole files. A file stream with a checkpoint takes each of them once,
until none is left (``availableNow``). Every trace gets a split by its prompt's hash, so that no prompt is in
both splits, and a reason, the first that holds of:

- ``missing_prompt``, ``missing_response``: null or blank;
- ``over_length``: more characters than ``most_chars``;
- ``duplicate_trace``: a trace of the same prompt and response was accepted, before or in this batch;
- ``extra_eval_trace``, ``too_many_train_traces``: its prompt has had its share of accepted traces;
- ``accepted``.

Within a batch the order is that of ids, nulls first, then of places in the files. TARGET is partitioned by batch and
split. A batch replaces its own partitions and looks only at those of earlier batches: a run that was stopped repeats its last
batch with the same result, and a run without new files changes nothing. Only accepted traces carry their texts.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobs.common import main, merged
from tallyweave.functions.text import hash_bucket, stable_hash
from tallyweave.operators.split import trace_id
from tallyweave.streaming.sink import append_batches, table

log = logging.getLogger("trace_intake")

#: ``prompt`` is an SQL expression over the source's columns. One bucket of prompts in ``buckets`` is for evaluation.
DEFAULTS = {"id": "doc_id", "prompt": "prompt", "response": "response", "seed": 42, "buckets": 5, "eval_per_prompt": 1, "train_per_prompt": 3, "most_chars": 16000, "files_per_batch": None}
COLUMNS = "trace_id long, prompt_sha256 string, trace string, n_chars long, reason string, prompt string, response string, batch long, split string"


def identified(rows: DataFrame, settings: dict) -> DataFrame:
    """The traces of ``rows`` with their hashes, split and the reasons that need no other trace; file and row tell them apart."""
    prompt, response = F.expr(settings["prompt"]).cast("string"), F.col(settings["response"]).cast("string")
    out = rows.select(F.col(settings["id"]).cast("long").alias("trace_id"), prompt.alias("prompt"), response.alias("response"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    bucket = hash_bucket(stable_hash(F.lit(str(settings["seed"])), F.coalesce("prompt", F.lit(""))), settings["buckets"])
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    own = F.when(blank("prompt"), "missing_prompt").when(blank("response"), "missing_response").when(F.length("response") > settings["most_chars"], "over_length")
    return out.withColumns(
        {
            "prompt_sha256": F.sha2("prompt", 256), "trace": F.when(own.isNull(), trace_id(F.col("prompt"), F.col("response"))), "n_chars": F.length("response").cast("long"),
            "split": F.when(bucket == 0, "eval").otherwise("train"), "own": own,
        }
    )


def decided(rows: DataFrame, before: DataFrame, settings: dict) -> DataFrame:
    """``COLUMNS`` without batch, of ``identified`` rows; ``before`` (trace, prompt_sha256) was accepted earlier.

    Only hashes, ids and places are sorted or shuffled to decide; the first of a trace and the first few of a prompt are kept by task before
    they meet. Texts join last, by place.
    """
    at = [F.col("trace_id").asc_nulls_first(), "file", "row"]
    slim = rows.where("own is null").select("trace_id", "file", "row", "trace", "prompt_sha256", "split")
    # the first of a trace before the join: a trace that many rows repeat is one row a task by then
    first = slim.withColumn("k", F.row_number().over(Window.partitionBy("trace").orderBy(*at))).where("k = 1").join(before.select("trace"), "trace", "left_anti")
    most = F.when(F.col("split") == "eval", settings["eval_per_prompt"]).otherwise(settings["train_per_prompt"])
    few = first.withColumn("k", F.row_number().over(Window.partitionBy("prompt_sha256").orderBy(*at)))
    few = few.where(F.col("k") <= max(settings["eval_per_prompt"], settings["train_per_prompt"]))
    had = before.groupBy("prompt_sha256").agg(F.count("*").alias("had"))
    taken = few.join(had, "prompt_sha256", "left").where(F.col("k") + F.coalesce("had", F.lit(0)) <= most)
    known = taken.select("trace", F.col("file").alias("t_file"), F.col("row").alias("t_row")).unionByName(before.select("trace").distinct(), allowMissingColumns=True)
    out = rows.where("own is null").join(known.withColumn("known", F.lit(True)), "trace", "left")
    own_place = (F.col("file") == F.col("t_file")) & (F.col("row") == F.col("t_row"))
    reason = F.when(own_place, "accepted").when(F.col("known"), "duplicate_trace").when(F.col("split") == "eval", "extra_eval_trace").otherwise("too_many_train_traces")
    # rows with a reason of their own have no trace to join by, and would meet in one task
    out = out.select(*rows.columns, reason.alias("reason")).unionByName(rows.where("own is not null").withColumn("reason", F.col("own")))
    text = lambda c: F.when(F.col("reason") == "accepted", F.col(c)).alias(c)
    return out.select("trace_id", "prompt_sha256", "trace", "n_chars", "reason", text("prompt"), text("response"), "split")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, settings: dict) -> None:
    """Take what is new in ``source``; returns when the stream has ended."""
    settings = merged(DEFAULTS, settings)

    def wrote(own: SparkSession, number: int) -> None:
        counts = output(own, target).where(F.col("batch") == number).groupBy("split", "reason").count().orderBy("split", "reason").collect()
        log.info("batch %d of %s to %s: %s", number, source, target, ", ".join(f"{r['split']} {r['reason']} {r['count']}" for r in counts) or "nothing")

    def make(batch: DataFrame, before: DataFrame) -> DataFrame:
        return decided(batch, before.where("reason = 'accepted'").select("trace", "prompt_sha256"), settings)

    source = source.rstrip("/")
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema)
    if settings["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", settings["files_per_batch"])
    # as a pattern that matches the source alone: a stream takes folders and patterns, but no single file by its name
    rows = identified(stream.parquet(f"{source[:-1]}[{source[-1]}]"), settings)
    query = append_batches(rows, make, COLUMNS, target, checkpoint, ("split",), wrote)
    query.awaitTermination()
    log.info("read %s up to the last file there, %d new rows", source, sum(p["numInputRows"] for p in query.recentProgress))


def output(spark: SparkSession, target: str) -> DataFrame:
    """The decisions of all batches."""
    return table(spark, COLUMNS, target)


if __name__ == "__main__":
    main(run, "trace_intake", ["source", "target", "checkpoint"], __doc__)
