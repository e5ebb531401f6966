"""Trace rows: validation, identities, prompts, and the rows that are published or trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators.masking import HIDDEN

MESSAGES = "array<struct<role: string, content: string>>"
CHOICES = ("A", "B", "C", "D")


def require(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """``df``; a row for which ``ok`` is not true raises when it is read."""
    said = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def first_of(df: DataFrame, *names: str) -> Column:
    """The first value that is not null among those columns of ``df`` that are there."""
    there = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def blank(c: Column) -> Column:
    """Whether a string is null or nothing but white space."""
    return text.strip(F.coalesce(c, F.lit(""))) == ""


def normalised_messages(messages: Column) -> Column:
    """Exactly a user's and an assistant's message, stripped and not empty; else null."""
    clean = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), text.strip(m["content"]).alias("content")))
    roles = F.transform(messages, lambda m: m["role"])
    good = (F.size(messages) == 2) & (roles == F.array(F.lit("user"), F.lit("assistant"))) & ~F.exists(messages, lambda m: blank(m["content"]))
    return F.when(F.coalesce(good, F.lit(False)), clean)


def reject_reason(messages: Column) -> Column:
    """The first rule that a row breaks by itself: messages, an open thinking mark, no boxed choice; null if none."""
    said = F.get(messages, F.lit(1))["content"]
    return (
        F.when(normalised_messages(messages).isNull(), "invalid_messages")
        .when(~(said.contains(text.THINK) & said.contains(text.END_THINK)), "incomplete_thinking_trace")
        .when(text.boxed_choice(said).isNull(), "missing_boxed_choice")
    )


def prompt_identity(known: Column, prompt: Column) -> Column:
    """The recorded digest of a prompt, else the prompt's; without either a row raises."""
    own = F.when(F.coalesce(prompt, F.lit("")) != "", F.sha2(prompt, 256)).otherwise(F.raise_error(F.lit("a row has no prompt identity")).cast("string"))
    return F.coalesce(known, own)


def response_text(response: Column, messages: Column) -> Column:
    """The response, else the last assistant message; null without."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.coalesce(response, F.try_element_at(said, F.lit(-1))["content"])


def solution_identity(solution: Column, gold: Column) -> Column:
    return F.coalesce(solution, gold)


def prompt_text(messages: Column, prompt: Column) -> Column:
    """Messages rendered with role marks, else the prompt; without either a row raises. Messages that are there win, even empty ones."""
    own = F.when(F.coalesce(prompt, F.lit("")) != "", prompt).otherwise(F.raise_error(F.lit("a row has neither prompt nor messages")).cast("string"))
    return F.when(messages.isNotNull(), text.role_prefixed(messages)).otherwise(own)


def published(traces: DataFrame) -> DataFrame:
    """Traces (index, response, solution, prompt, messages) in the order of their index without it; a prompt takes the place of messages."""
    one = traces.orderBy("index").withColumn("messages", F.when(F.col("prompt").isNull(), F.col("messages")))
    return one.select("response", "solution", "prompt", "messages")


def gold_rows(rows: DataFrame, *carried: str) -> DataFrame:
    """(carried..., prompt, response, solution) from (messages, gold): the last message must be an assistant's and the choice one of four."""
    last = F.try_element_at("messages", F.lit(-1))
    choice = F.upper(F.coalesce("gold", F.lit("")))
    rows = require(rows, F.size("messages") >= 2, "invalid messages")
    rows = require(rows, last["role"] == "assistant", "missing assistant target")
    rows = require(rows, choice.isin(*CHOICES), "invalid gold choice")
    prompt = text.chat_prompt(F.slice("messages", F.lit(1), F.size("messages") - 1))
    return rows.select(*carried, prompt.alias("prompt"), text.without_second_think(prompt, F.coalesce(last["content"], F.lit(""))).alias("response"), F.concat(F.lit("\\boxed{"), choice, F.lit("}")).alias("solution"))


def policy_rows(rows: DataFrame, split: str, source: str, environment: str = "aime", expected: int | None = None) -> DataFrame:
    """Prompts with their gold choice in nested columns, from (idx, messages, gold, prompt_sha256); idx counts from 0.

    The recorded choice counts as it is, else the boxed one, and must be one of four. With ``expected`` the
    count of rows is checked at once.
    """
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"expected {expected} {split} rows, found {n}")
    said = F.coalesce(F.try_element_at("messages", F.lit(-1))["content"], F.lit(""))
    rows = require(rows, F.size("messages") >= 2, "invalid messages").withColumn("choice", F.coalesce(F.nullif("gold", F.lit("")), text.boxed_choice(said)))
    rows = require(rows, F.col("choice").isin(*CHOICES), "no valid gold choice")
    return rows.select(
        F.lit(source).alias("data_source"),
        F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"),
        F.lit(environment).alias("env_class"),
        F.struct(F.lit("rule").alias("style"), F.col("choice").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("idx").alias("index"), F.col("choice").alias("gold_choice"), "prompt_sha256").alias("extra_info"),
    )


def encoded_trace(prompt_ids: Column, response_ids: Column, end: int | None, most: int) -> Column:
    """Struct (ids, response_start): prompt and response with one end id, cut to ``most``."""
    closed = response_ids if end is None else F.when(F.try_element_at(response_ids, F.lit(-1)) == end, response_ids).otherwise(F.concat(response_ids, F.array(F.lit(end).cast("long"))))
    ids = F.slice(F.concat(prompt_ids, closed), 1, most)
    return F.struct(ids.alias("ids"), F.least(F.size(prompt_ids), F.size(ids)).alias("response_start"))


def nll_example(prompt_ids: Column, response_ids: Column, most: int | None = None) -> Column:
    """Struct (input_ids, labels): no end id is added; cut only if ``most`` is over 0."""
    ids = F.concat(prompt_ids, response_ids)
    labels = F.concat(F.array_repeat(F.lit(HIDDEN).cast("long"), F.size(prompt_ids)), response_ids)
    cut = (lambda c: F.slice(c, 1, most)) if most else (lambda c: c)
    return F.struct(cut(ids).alias("input_ids"), cut(labels).alias("labels"))


def ids_in_range(df: DataFrame, column: str, vocabulary: int) -> DataFrame:
    """``df``; a token id outside 0..vocabulary-1 raises when it is read."""
    return require(df, (F.col(column) >= 0) & (F.col(column) < vocabulary), F.concat(F.lit("token id out of range: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
