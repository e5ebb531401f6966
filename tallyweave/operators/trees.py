"""Reply trees: chains of parents, prompts and conversation flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions.text import chat_prompt, strip
from tallyweave.operators.traces import first_of
from tallyweave.session import shared_dir


def _kept(df: DataFrame) -> DataFrame:
    """``df`` computed into the shared folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _keyed(messages: DataFrame) -> DataFrame:
    """``messages`` with a key of each row's contents; rows that repeat have the same."""
    return messages.withColumn("key", F.xxhash64("message_id", "parent_id", "role", "text"))


def _chains(keyed: DataFrame) -> DataFrame:
    """(chain, message_id, ids): each message's chain from its root, without the texts: ``ids`` is an array of (id, key, role); see ``message_chains``."""
    one = F.array(F.struct(F.col("message_id").alias("id"), "key", "role"))
    state = _kept(keyed.select("message_id", F.col("parent_id").alias("top"), one.alias("ids")))
    out, open_ = state.where("top is null"), state.where("top is not null")
    while not open_.isEmpty():
        above = out.unionAll(open_).select(F.col("message_id").alias("a_id"), F.col("top").alias("a_top"), F.col("ids").alias("a_ids"))
        joined = open_.join(above, F.col("top") == F.col("a_id")).select("message_id", F.col("a_top").alias("top"), F.concat("a_ids", "ids").alias("ids"))
        joined = _kept(joined.withColumn("again", F.size(F.array_distinct("ids.id")) < F.size("ids")))
        ended = joined.where("top is null")
        if not ended.where("again").isEmpty():
            raise ValueError("the messages' parents form a cycle")
        out, open_ = out.unionAll(ended.drop("again")), joined.where("top is not null and not again").drop("again")
    return out.select("message_id", "ids").withColumn("chain", F.monotonically_increasing_id())  # of kept rows: it stays


def _paths(chains: DataFrame, keyed: DataFrame) -> DataFrame:
    """(chain, path): the (role, content) of each of ``ids``; texts are shuffled once, and once more for every chain they are in."""
    said = keyed.select(F.col("message_id").alias("t_id"), F.col("key").alias("t_key"), F.col("role").alias("t_role"), "text").dropDuplicates(["t_id", "t_key"])
    each = chains.select("chain", F.posexplode("ids").alias("at", "x")).select("chain", "at", F.col("x.id").alias("x_id"), F.col("x.key").alias("x_key"))
    each = each.join(said, F.col("x_id").eqNullSafe(F.col("t_id")) & (F.col("x_key") == F.col("t_key")))
    whole = each.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("at", F.col("t_role").alias("role"), F.col("text").alias("content")))).alias("path"))
    return whole.select("chain", F.transform("path", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("path"))


def message_chains(messages: DataFrame) -> DataFrame:
    """(message_id, depth, path): messages (message_id, parent_id, role, text) with the chain from their root.

    Chains double: each round joins what is known of a message's oldest known ancestor in front, so that chains of n messages take log2(n) joins; ids alone
    go through them, texts are put in at the end. ``path`` is an array of (role, content). A message whose parent is missing begins no chain, and messages that
    only lead to each other have no root and are left out. An id that repeats below itself is a cycle below a root and raises.
    """
    keyed = _keyed(messages)
    chains = _chains(keyed)
    return chains.join(_paths(chains, keyed), "chain").select("message_id", (F.size("path") - 1).alias("depth"), "path")


def first_reply(replies: DataFrame, least_chars: int = 16) -> DataFrame:
    """The first reply that is long enough below each parent, by rank (missing last) and id."""
    order = Window.partitionBy("parent_id").orderBy(F.coalesce("rank", F.lit(float("inf"))), "message_id")
    good = replies.where(F.length(F.trim("text")) >= least_chars)
    return good.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def tree_messages(rows: DataFrame) -> DataFrame:
    """Raw message rows under one set of names; ids and parents as strings, a rank that is no number last."""
    return rows.select(
        first_of(rows, "message_id", "id").cast("string").alias("message_id"),
        first_of(rows, "parent_id").cast("string").alias("parent_id"),
        F.coalesce(first_of(rows, "message_tree_id", "conversation_id").cast("string"), F.lit("")).alias("tree_id"),
        F.coalesce(first_of(rows, "rank").try_cast("double"), F.lit(float("inf"))).alias("rank"),
        "role",
        "text",
        first_of(rows, "lang").cast("string").alias("lang"),
        F.coalesce(first_of(rows, "deleted").cast("boolean"), F.lit(False)).alias("deleted"),
        F.coalesce(first_of(rows, "review_count").cast("int"), F.lit(0)).alias("review_count"),
    )


def reply_prompts(rows: DataFrame, lang: str | None = "en", least_reviews: int = 1, least_chars: int = 16, most_chars: int = 8000, limit: int | None = None) -> DataFrame:
    """Contexts of assistant replies as messages: one for each parent, of its first good reply in order.

    Replies are ordered by tree, rank and id. A reply counts if it is long and reviewed enough, its whole chain is
    there and begins with a prompter, something comes before it, and the rendered context is neither empty nor too
    long. Returns messages, lang, assistant_message_id, parent_id, message_tree_id, depth (the reply included),
    review_count and rank.
    """
    held = tree_messages(rows).where(~F.col("deleted") & F.col("role").isin("prompter", "assistant") & (F.coalesce("message_id", F.lit("")) != ""))
    if lang:
        held = held.where(F.col("lang") == lang)
    keyed = _keyed(held.select("message_id", "parent_id", "role", "text"))
    replies = held.where((F.col("role") == "assistant") & (F.length(strip(F.coalesce("text", F.lit("")))) >= least_chars) & (F.col("review_count") >= least_reviews))
    found = replies.drop("role", "text").join(_chains(keyed), "message_id").withColumn("depth", F.size("ids") - 1)
    found = found.where((F.col("depth") > 0) & (F.get("ids", F.lit(0))["role"] == "prompter"))
    before = found.select("chain", F.slice("ids", F.lit(1), F.col("depth")).alias("ids")).dropDuplicates(["chain"])
    found = found.join(_paths(before, keyed), "chain")
    user = lambda m: F.when(m["role"] == "prompter", "user").otherwise("assistant")
    before = F.transform("path", lambda m: F.struct(user(m).alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    found = found.withColumn("messages", before)
    rendered = F.length(chat_prompt(F.col("messages")))
    found = found.where((rendered > 0) & (rendered <= most_chars))
    order = ("tree_id", "rank", "message_id")
    one = found.withColumn("place", F.row_number().over(Window.partitionBy("parent_id").orderBy(*order))).where("place = 1")
    if limit is not None:
        one = one.orderBy(*order).limit(limit)
    return one.select("messages", "lang", F.col("message_id").alias("assistant_message_id"), "parent_id", F.col("tree_id").alias("message_tree_id"), (F.col("depth") + 1).alias("depth"), "review_count", F.nullif("rank", F.lit(float("inf"))).alias("rank"))
