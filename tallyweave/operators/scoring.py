"""Scores over rows of token probabilities: nucleus, tilt, boost, entropy, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nucleus(rows: DataFrame, group: str, p: str, token: str, top_p: float) -> DataFrame:
    """Keep the most probable tokens whose preceding mass is at most ``top_p``; ties by token."""
    order = Window.partitionBy(group).orderBy(F.desc(p), token).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("before", F.sum(p).over(order) - F.col(p)).where(F.col("before") <= top_p)


def candidates(rows: DataFrame, group: str, p: str, token: str, top_p: float, first: int = 2) -> tuple[int, DataFrame]:
    """The least k of ``first``, twice that, ... for which the k most probable tokens of every group have a mass of ``top_p``, or are all its tokens; and the nucleus among them.

    One action for each k. Tokens behind the k-th of their group are dropped by the tasks that read them, before the shuffle; ties by token.
    """
    order = Window.partitionBy(group).orderBy(F.desc(p), token)
    k = first
    while True:
        top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        mass = top.groupBy(group).agg(F.sum(F.when(F.col("place") <= k, F.col(p))).alias("mass"), F.max("place").alias("n"))
        if top_p >= 1 or mass.where((F.col("mass") < top_p) & (F.col("n") > k)).isEmpty():
            break
        k *= 2
    kept = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return k, (nucleus(kept, group, p, token, top_p) if top_p < 1 else kept).drop("place")


def argmax_first(value: Column, tie: Column, result: Column) -> Column:
    """``result`` of the greatest value; of equal ones that of the least ``tie``."""
    return F.max_by(result, F.struct(value, -tie))


def trace_weights(rows: DataFrame, trace: str, entropy: str) -> DataFrame:
    """Add norm, sqrt_weight and linear_weight from the entropies' range within a trace (all one if it has none)."""
    w = Window.partitionBy(trace)
    low, high = F.min(entropy).over(w), F.max(entropy).over(w)
    df = rows.withColumns({"w_low": low, "w_range": high - low})
    norm = F.when(F.col("w_range") < 1e-8, F.lit(1.0)).otherwise((F.col(entropy) - F.col("w_low")) / F.col("w_range"))
    df = df.withColumn("norm", norm).drop("w_low", "w_range")
    return df.withColumns({"sqrt_weight": F.sqrt("norm"), "linear_weight": 0.1 + 0.9 * F.col("norm")})


def _ends(group: str, score: str | None, token: str | None, end: int | None) -> Column:
    """Whether the token with a group's greatest score, of equal ones the least, is ``end``; never without an end."""
    if end is None:
        return F.lit(False)
    top = F.max_by(token, F.struct(F.col(score), -F.col(token))).over(Window.partitionBy(group))
    return top == end


def boosted(rows: DataFrame, group: str, score: str, hit: str, delta: float, token: str | None = None, end: int | None = None) -> DataFrame:
    """Add ``boosted``: the score, and ``delta`` more for hits; as it is in groups whose best token is ``end``."""
    more = F.when(F.col(hit) & ~_ends(group, score, token, end), F.lit(float(delta))).otherwise(F.lit(0.0))
    return rows.withColumn("boosted", F.col(score) + more)


def tilted(rows: DataFrame, group: str, p: str, hit: str, strength: float, score: str | None = None, token: str | None = None, end: int | None = None) -> DataFrame:
    """Add ``tilt``: strength * p * (hit - the group's expected hit); zero in groups whose token with the best ``score`` is ``end``."""
    w = Window.partitionBy(group)
    g = F.col(hit).cast("double")
    tilt = strength * F.col(p) * (g - F.sum(F.col(p) * g).over(w))
    return rows.withColumn("tilt", tilt if end is None else F.when(_ends(group, score, token, end), F.lit(0.0)).otherwise(tilt))


def open_value(p: Column, hit: Column, shared: Column) -> Column:
    """Mass of hits over mass of the shared vocabulary; NaN without shared mass."""
    part, whole = F.sum(F.when(hit & shared, p).otherwise(0.0)), F.sum(F.when(shared, p).otherwise(0.0))
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(part / F.when(whole == 0, F.lit(None)).otherwise(whole))


def fused_score(a: Column, b: Column, alpha: float) -> Column:
    """Weighted sum of -log(1 - s) over two scores, each held just below one."""
    one = lambda s: -F.log1p(-F.least(s, F.lit(1 - 1e-12)))
    return alpha * one(a) + (1 - alpha) * one(b)


def entropy(logit: Column) -> Column:
    """Aggregate: log of the summed exponentials less the expected logit."""
    return F.log(F.sum(F.exp(logit))) - F.sum(F.exp(logit) * logit) / F.sum(F.exp(logit))
