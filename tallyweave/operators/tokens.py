"""Token positions, contexts and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions.keyed_hash import token_id


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, token): stand-in tokens of lower-cased words split at single spaces."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.lower(text_col), " ")).alias("pos", "word")).select("id", "pos", token_id(F.col("word")).alias("token"))


def token_arrays(docs: DataFrame, id_col: str, text_col: str, *carried: str) -> DataFrame:
    """(id, carried..., tokens array): one row a text; a null text has a null array.

    Behind a generator: conditions on tokens are not pushed below it, so that ids are computed once a text.
    """
    ids = F.transform(F.split(F.lower(text_col), " "), lambda w: token_id(w))
    return docs.select(F.col(id_col).alias("id"), *carried, F.explode(F.array(ids)).alias("tokens"))


def bigrams(arrays: DataFrame, *carried: str) -> DataFrame:
    """(id, carried..., pos, prev, cur, token) of token arrays (id, tokens): -1 before the start, and the next token as ``token``.

    Positions without a next token are left out. Neighbours come from the array itself, so nothing is shuffled.
    """
    n = F.greatest(F.size("tokens") - 1, F.lit(0))
    cur = F.slice("tokens", F.lit(1), n)
    prev = F.slice(F.concat(F.array(F.lit(-1).cast("long")), F.col("tokens")), F.lit(1), n)
    rows = F.arrays_zip(prev.alias("prev"), cur.alias("cur"), F.slice("tokens", F.lit(2), n).alias("token"))
    at = arrays.select("id", *carried, F.posexplode(rows).alias("pos", "gram"))
    return at.select("id", *carried, "pos", F.col("gram.prev").alias("prev"), F.col("gram.cur").alias("cur"), F.col("gram.token").alias("token"))


def ngrams(arrays: DataFrame, n: int, first: int | None = None) -> DataFrame:
    """(id, pos, context array, target) for n tokens of context.

    With ``first`` None the corpus rule holds: targets from position n + 1, so texts of n + 1 tokens or fewer give
    nothing; else targets start at max(first, n).
    """
    start = n + 1 if first is None else max(first, n)
    places = F.when(F.size("tokens") > start, F.sequence(F.lit(start), F.size("tokens") - 1)).otherwise(F.array().cast("array<int>"))
    at = arrays.select("id", "tokens", F.explode(places).alias("pos"))
    return at.select("id", "pos", F.slice("tokens", F.col("pos") - n + 1, n).alias("context"), F.get("tokens", F.col("pos")).alias("target"))


def _different(rows: Column) -> Column:
    """How many different elements an array has: sorted, equal ones are neighbours. The sorted array is bound by a lambda, else each use would sort."""

    def changes(ordered: Column) -> Column:
        rest = F.greatest(F.size(ordered) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(ordered, F.lit(1), rest), F.slice(ordered, F.lit(2), rest), lambda a, b: a != b)
        return F.size(F.filter(pairs, lambda x: x)) + F.least(F.size(ordered), F.lit(1))

    return F.get(F.transform(F.array(F.sort_array(rows)), changes), F.lit(0)).cast("long")


def ngram_counts(arrays: DataFrame, n: int) -> DataFrame:
    """(id, n, contexts, pairs): by the corpus rule, the targets of each array, and its different contexts of n tokens, alone and with
    their target; arrays without a target are left out. Sorted and counted inside the row, nothing is shuffled."""
    long = arrays.where(F.size("tokens") > n + 1)
    count = F.size("tokens") - n - 1
    part = lambda i: F.slice("tokens", F.lit(2 + i), count)
    grams = lambda k: F.arrays_zip(*(part(i).alias(f"c{i}") for i in range(k)))
    return long.select("id", count.cast("long").alias("n"), _different(grams(n)).alias("contexts"), _different(grams(n + 1)).alias("pairs"))


#: Bits of the integer types.
_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def packed_order(df: DataFrame, order: list[str]) -> Column:
    """One decimal that orders rows as the integer columns ``order`` do, nulls first; a struct where 38 digits are too few.

    Aggregates by a number are hashed; by a struct all rows are sorted before they are combined.
    """
    bits = [_BITS.get(df.schema[c].dataType.typeName()) for c in order]
    if None in bits or sum(bits) > 124:
        return F.struct(*order)
    place = None
    for c, b in zip(order, bits, strict=True):
        own = F.coalesce(F.col(c), F.lit(-(1 << (b - 1))).cast(df.schema[c].dataType)).cast("decimal(20,0)")
        place = own if place is None else place * F.lit(str(1 << b)).cast(f"decimal({len(str(1 << b))},0)") + own
    return place


def first_occurrence(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's first row by ``order``, combined before the shuffle."""
    place = packed_order(df, order)
    return df.groupBy(*keys).agg(*(F.min_by(v, place).alias(v) for v in values), F.count("*").alias("times"))


#: Bits of a stand-in token, see ``token_id``.
TOKEN_BITS = 18
#: Characters of text whose contexts one task takes: their table fits in its memory, so that nothing is spilled.
TASK_CHARS = 20_000_000


def first_grams(docs: DataFrame, text_col: str, order: list[str], *carried: str, part: str | None = None) -> DataFrame:
    """(carried..., part, prev, cur, token, times): each context's first next token by the integer columns ``order`` and place, and how often it stands.

    Contexts are of each carried value, and of each ``part`` (an int from 0 below 2^26). Where the ranges of ``order``, of places and tokens fit in 63 bits
    together (the ranges are asked first), a context and its place with the token are shuffled as two numbers, else as columns. Nearly all contexts
    of a task are different, so they are not combined before the shuffle, where their table would outgrow the task.
    """
    rows = docs.select(*order, text_col, *carried, *([part] if part else []))
    asked = rows.agg(F.max(F.length(text_col)).alias("longest"), F.sum(F.length(text_col)).alias("chars"), *(f(c).alias(f"{f.__name__}_{c}") for c in order for f in (F.min, F.max))).first()
    pos_bits, place, bits = ((asked["longest"] or 0) + 1).bit_length(), F.lit(0).cast("long"), 0
    for c in order:  # null is 0, the least is 1
        low, high = asked[f"min_{c}"] or 0, asked[f"max_{c}"] or 0
        own = (high - low + 1).bit_length()
        bits += own
        if bits + pos_bits + TOKEN_BITS <= 63:
            place = F.shiftleft(place, own) + F.coalesce(F.col(c).cast("long") - (low - 1), F.lit(0))
    keys = [*carried, *([part] if part else [])]
    if bits + pos_bits + TOKEN_BITS > 63:
        own = [f"order_{i}" for i in range(len(order))]  # no name of ``bigrams``
        rows = rows.withColumns({"id_": F.lit(0), **{o: F.col(c) for o, c in zip(own, order)}})
        wide = bigrams(token_arrays(rows, "id_", text_col, *own, *keys), *own, *keys)
        return first_occurrence(wide, [*keys, "prev", "cur"], [*own, "pos"], ["token"])
    grams = bigrams(token_arrays(rows.withColumn("place_", place), "place_", text_col, *keys), *keys)
    context = F.shiftleft(F.col("prev") + 1, TOKEN_BITS).bitwiseOR(F.col("cur"))
    if part:
        context = F.shiftleft(F.col(part).cast("long"), 2 * TOKEN_BITS).bitwiseOR(context)
    at = F.shiftleft(F.shiftleft("id", pos_bits).bitwiseOR(F.col("pos").cast("long")), TOKEN_BITS).bitwiseOR(F.col("token"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(asked["chars"] or 0) // TASK_CHARS))
    dealt = grams.select(*carried, context.alias("context_"), at.alias("at_")).repartition(tasks, *carried, "context_")
    firsts = dealt.groupBy(*carried, "context_").agg(F.min("at_").alias("at_"), F.count("*").alias("times"))
    low = lambda x: x.bitwiseAND(F.lit((1 << TOKEN_BITS) - 1))
    own = [F.shiftright("context_", 2 * TOKEN_BITS).cast("int").alias(part)] if part else []
    return firsts.select(*carried, *own, (low(F.shiftright("context_", TOKEN_BITS)) - 1).alias("prev"), low(F.col("context_")).alias("cur"), low(F.col("at_")).alias("token"), "times")


def shard_order(id_: Column, world: int) -> Column:
    """One integer that orders rows dealt round robin by rank, then local place; ids from 0 on."""
    rank, place = shard(id_, world)
    return (rank * F.lit((1 << 63) // world if world > 1 else 1) + place).cast("long")


def shard(id_: Column, world: int) -> tuple[Column, Column]:
    """Rank and local place of a row dealt round robin."""
    return id_ % world, F.floor(id_ / world).cast("long")
