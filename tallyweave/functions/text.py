"""Scalar text functions over columns: answers, choices, chat rendering, model names and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of answers.
BOXED = r"(?i)\\boxed\s*\{\s*([A-D])\s*\}"
SAID = r"(?i)(?:final\s+answer|answer|option|choice)\s*(?:is|:)?\s*[*\\(\[]*([A-D])\b"
NUMBER = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:/\d+)?"
THINK, END_THINK = "<think>", "</think>"
NUL = chr(0)
# Part of a model's name, and the short name it stands for.
DISTILLED = ("deepseek-r1-distill", "r1-distill-7b")


def stable_hash(*parts: Column) -> Column:
    """Hex sha256 of the parts joined by a zero character."""
    return F.sha2(F.concat_ws(NUL, *(p.cast("string") for p in parts)), 256)


def hash_bucket(digest: Column, buckets: int) -> Column:
    """The digest's first 16 hex digits as an unsigned integer, modulo ``buckets``."""
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def boxed_choice(text: Column) -> Column:
    """The last boxed letter, upper case, or null."""
    return F.upper(last_match(text, BOXED))


def choice(text: Column) -> Column:
    """The last boxed letter, else the letter that the text last says is the answer."""
    return F.coalesce(boxed_choice(text), F.upper(last_match(text, SAID)))


def choice_correct(predicted: Column, gold: Column) -> Column:
    """Whether both are there and equal; null never is."""
    return F.coalesce(predicted == gold, F.lit(False))


def numeric_answer(text: Column, strict: bool = True) -> Column:
    """The first number after the last ``####``, without commas.

    Texts without the mark or a number behind it raise, or are null unless ``strict``; so is null itself.
    """
    number = F.regexp_replace(F.regexp_extract(F.substring_index(text, "####", -1), NUMBER, 0), ",", "")
    bad = F.raise_error(F.concat(F.lit("no number after ####: "), F.left(text, F.lit(80)))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(text.contains("####") & (number != ""), number).when(text.isNotNull(), bad)


def chatml(messages: Column) -> Column:
    """Messages (array of role, content) with turn marks."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(messages, one), "")


def chat_prompt(messages: Column) -> Column:
    """Messages with turn marks, contents stripped, lines joined, ending in an open assistant turn; empty if a role or what is left of a content is."""
    messages = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    bad = F.exists(messages, lambda m: (F.coalesce(m["role"], F.lit("")) == "") | (m["content"] == ""))
    role = lambda m: F.when(m["role"] == "prompter", "user").otherwise(m["role"])
    lines = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), role(m), F.lit("\n"), m["content"], F.lit("<|im_end|>")))
    return F.when(bad, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n<|im_start|>assistant\n")))


def role_prefixed(messages: Column) -> Column:
    """``Role: text`` lines of the messages that say something, and an open assistant line."""
    said = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.concat(F.array_join(F.transform(said, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.rtrim(m["content"]))), "\n"), F.lit("\nAssistant:"))


def think_split(text: Column) -> Column:
    """Struct (prefix, rest): an opening thinking mark, or empty, and what follows."""
    has = text.startswith(THINK)
    return F.struct(F.when(has, THINK).otherwise("").alias("prefix"), F.when(has, F.substr(text, F.lit(len(THINK) + 1))).otherwise(text).alias("rest"))


def without_second_think(prompt: Column, response: Column) -> Column:
    """The response without its opening mark and the newlines behind it where the prompt ends with one, white space aside."""
    inner = F.regexp_replace(response, r"^(?U)\s+", "")
    twice = F.regexp_replace(prompt, r"(?U)\s+$", "").endswith(THINK) & inner.startswith(THINK)
    return F.when(twice, F.ltrim(F.substr(inner, F.lit(len(THINK) + 1)), F.lit("\n"))).otherwise(response)


def model_short_name(name: Column) -> Column:
    """Last part of a path, lower case, letters, digits, dots and hyphens only; ``model`` if nothing is left."""
    low = F.lower(F.substring_index(name, "/", -1))
    low = F.when(low.contains(DISTILLED[0]), DISTILLED[1]).otherwise(low)
    short = F.regexp_replace(low, r"[^\p{L}\p{N}.\-]", "")
    return F.when(short == "", "model").otherwise(short)
