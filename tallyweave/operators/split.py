"""Leakage-free split with quotas, as a relational plan of what a scan with early stop would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions.text import hash_bucket, stable_hash
from tallyweave.operators.traces import normalised_messages, reject_reason
from tallyweave.session import new_path


def trace_id(prompt: Column, response: Column) -> Column:
    """The identity of a trace: a hash of its texts' hashes."""
    return stable_hash(F.sha2(prompt, 256), F.sha2(response, 256))


def order_key(seed: int, split: Column, prompt: Column, response: Column) -> Column:
    """What the rows of a split are ordered by: a hash, so that the order is stable and tells nothing."""
    return stable_hash(F.lit(str(seed)), split, F.sha2(prompt, 256), F.sha2(response, 256))


def leakage_free_split(rows: DataFrame, seed: int = 42, train: int = 9000, evaluation: int = 1000, per_prompt: int = 3, most_tokens: int = 4096, buckets: int = 5) -> DataFrame:
    """Decide on rows (scan_pos, prompt, response, n_tokens) in scan order.

    Adds trace (hash), split, accepted and reason, and leaves out rows behind the place where both quotas were full.
    Prompts go to a split by hash, so none is in both. A row is a duplicate if its trace was accepted before;
    then too long; then its split is full or its prompt has had its share. A column ``own_reason`` in ``rows`` is a reason that a row has by
    itself, which comes before these and keeps it out. Only traces and places are sorted, no texts; they are written to the shared folder once.
    """
    own = F.col("own_reason") if "own_reason" in rows.columns else F.lit(None).cast("string")
    digest = stable_hash(F.lit(str(seed)), F.col("prompt"))
    base = rows.withColumns(
        {"trace": trace_id(F.col("prompt"), F.col("response")), "split": F.when(hash_bucket(digest, buckets) == 0, "eval").otherwise("train"), "fits": (F.col("n_tokens") <= most_tokens) & own.isNull()}
    )
    path = new_path(rows.sparkSession, "split")
    slim = base.where("fits").select("scan_pos", F.sha2("prompt", 256).alias("prompt"), "trace", "split")
    slim.write.parquet(path)
    slim = rows.sparkSession.read.schema(slim.schema).parquet(path)
    first = slim.groupBy("trace").agg(F.min("scan_pos").alias("scan_pos"), F.min_by("prompt", "scan_pos").alias("prompt"), F.min_by("split", "scan_pos").alias("split"))
    share = F.row_number().over(Window.partitionBy("prompt").orderBy("scan_pos"))
    first = first.withColumn("share", share).where((F.col("share") <= F.when(F.col("split") == "eval", 1).otherwise(per_prompt)))
    # a sort that keeps no more than the quota's rows in every task, instead of a rank over the split
    of = {name: first.where(F.col("split") == name).orderBy("scan_pos").limit(quota).select("trace", "scan_pos") for name, quota in (("train", train), ("eval", evaluation))}
    taken = of["train"].unionAll(of["eval"])
    last = lambda name, quota: of[name].agg(F.when(F.count("*") == quota, F.max("scan_pos")).alias(f"full_{name}"))
    full = last("train", train).join(F.broadcast(last("eval", evaluation)))  # one row each
    accepted = taken.select(F.col("trace").alias("t_trace"), F.col("scan_pos").alias("t_pos"))
    joined = base.join(accepted, F.col("trace") == F.col("t_trace"), "left").join(F.broadcast(full))  # one row
    joined = joined.where(F.col("full_train").isNull() | F.col("full_eval").isNull() | (F.col("scan_pos") <= F.greatest("full_train", "full_eval")))
    past = lambda c: F.coalesce(F.col("scan_pos") > F.col(c), F.lit(False))
    reason = (
        F.when(own.isNotNull(), own)
        .when(F.col("scan_pos") == F.col("t_pos"), "accepted")
        .when(F.col("t_pos") < F.col("scan_pos"), "duplicate_trace")
        .when(~F.col("fits"), "over_token_limit")
        .when((F.col("split") == "eval") & past("full_eval"), "eval_full")
        .when(F.col("split") == "eval", "extra_eval_trace")
        .when(past("full_train"), "train_full")
        .otherwise("too_many_train_traces")
    )
    out = joined.withColumn("reason", reason)
    return out.select(*rows.columns, "trace", "split", (F.col("reason") == "accepted").alias("accepted"), "reason")


def prepared_split(rows: DataFrame, seed: int = 42, **quotas: int) -> DataFrame:
    """The whole chain of preparation on rows (scan_pos, messages, n_tokens, and any others): ``leakage_free_split`` after ``reject_reason``.

    Prompt and response are the stripped contents of the two messages; rows that are no such pair have null ones.
    """
    pair = normalised_messages(F.col("messages"))
    said = rows.withColumns({"prompt": F.get(pair, F.lit(0))["content"], "response": F.get(pair, F.lit(1))["content"], "own_reason": reject_reason(F.col("messages"))})
    return leakage_free_split(said, seed, **quotas).drop("own_reason")
