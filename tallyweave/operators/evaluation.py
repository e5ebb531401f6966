"""Summaries of evaluations: accuracies, likelihoods, detection, comparisons and what must hold of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import stats


def ratio(part: Column, whole: Column) -> Column:
    """``part`` / ``whole``, null for nothing."""
    return part / F.nullif(whole, F.lit(0))


def forced_accuracy(rows: DataFrame, raw: str, forced: str, solution: str) -> DataFrame:
    """One row on two verdicts a row over the same rows, those with a solution; without any such row it raises."""
    held = rows.where(F.coalesce(solution, F.lit("")) != "")
    s = held.agg(F.count("*").alias("num_examples"), F.count_if(raw).alias("raw_correct"), F.count_if(forced).alias("forced_correct"))
    n = F.when(F.col("num_examples") > 0, F.col("num_examples")).otherwise(F.raise_error(F.lit("no row can be evaluated")).cast("long"))
    return s.select(n.alias("num_examples"), "raw_correct", "forced_correct", ratio(F.col("raw_correct"), F.col("num_examples")).alias("raw_accuracy"), ratio(F.col("forced_correct"), F.col("num_examples")).alias("forced_accuracy"))


def mean_nll(rows: DataFrame, nll: str, tokens: str) -> DataFrame:
    """One row: examples, tokens, their summed loss and its mean (null without tokens); sums are doubles."""
    s = rows.agg(F.count("*").alias("num_examples"), F.coalesce(F.sum(tokens), F.lit(0)).alias("num_tokens"), F.coalesce(F.sum(F.col(nll).cast("double")), F.lit(0.0)).alias("total_nll"))
    return s.withColumn("mean_nll", ratio(F.col("total_nll"), F.col("num_tokens")))


def detection_summary(rows: DataFrame, p_value: str, scored: str) -> DataFrame:
    """One row on the tails of many samples: how many are under 0.01, and percentiles of their strength; zeros without samples."""
    power = stats.minus_log10(F.col(p_value))
    low = rows.agg(
        F.count("*").alias("samples"), F.count_if(F.col(p_value) < 0.01).alias("detected"), F.avg(power).alias("mean_strength"), F.percentile(power, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("ps"),
        F.percentile(F.col(scored), F.lit(0.5)).alias("median_scored"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return low.select(
        "samples", "detected", zero(ratio(F.col("detected"), F.col("samples"))).alias("detection_rate"), zero(F.col("mean_strength")).alias("mean_strength"),
        *(zero(F.get("ps", F.lit(i))).alias(n) for i, n in enumerate(("p25_strength", "median_strength", "p75_strength"))), zero(F.col("median_scored")).alias("median_scored"),
    )


def same_indices(left: DataFrame, right: DataFrame, index: str) -> None:
    """Raise unless both have the same set of indices; a repeated index counts once."""
    a, b = left.select(index).distinct(), right.select(index).distinct()
    apart = a.join(b, index, "left_anti").unionAll(b.join(a, index, "left_anti"))
    if some := [r[0] for r in apart.limit(10).collect()]:
        raise ValueError(f"indices that only one side has, ten at most: {sorted(some, key=str)}")


def compared(base: DataFrame, candidate: DataFrame, least_gain: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """One row on two sets of verdicts (index, correct) over the same indices; nulls and no pass without samples."""
    same_indices(base, candidate, "index")
    both = base.select("index", F.col("correct").alias("b")).join(candidate.select("index", F.col("correct").alias("c")), "index")
    s = both.agg(F.count("*").alias("samples"), F.count_if("b").alias("b"), F.count_if("c").alias("c"), F.count_if(~F.col("b") & F.col("c")).alias("improved"), F.count_if(F.col("b") & ~F.col("c")).alias("regressed"))
    s = s.withColumns({"base_accuracy": ratio(F.col("b"), F.col("samples")), "candidate_accuracy": ratio(F.col("c"), F.col("samples"))})
    s = s.withColumns({"gain": F.col("candidate_accuracy") - F.col("base_accuracy"), "p_value": stats.mcnemar_tail(F.col("improved"), F.col("regressed"))})
    return s.select("samples", "base_accuracy", "candidate_accuracy", "gain", "improved", "regressed", "p_value", stats.passes_gate(F.col("gain"), F.col("p_value"), least_gain, alpha).alias("passed"))


def recomputed(metrics: DataFrame, gamma: Column | float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Metrics (mean, num_measurements, p_value, detected) with their tail computed again: expected, agrees (tail and verdict) and detects."""
    out = metrics.withColumn("expected", stats.hoeffding(F.col("mean"), F.col("num_measurements"), gamma))
    near = F.abs(F.col("p_value") - F.col("expected")) <= F.greatest(1e-12 * F.greatest(F.abs("p_value"), F.abs("expected")), F.lit(1e-12))
    return out.withColumns({"detects": F.col("expected") < alpha, "agrees": F.coalesce(near & (F.col("detected") == (F.col("expected") < alpha)), F.lit(False))})


def accepted(conditions: DataFrame) -> DataFrame:
    """One row on (condition, variant, detected, base_accuracy, accuracy): what an accepted set of runs must show.

    Nothing is detected in the control, both known variants are in every other condition, all conditions share one
    base accuracy and are over it. Missing known variants are not detected.
    """
    known = F.col("variant").isin("open_supervised", "closed_supervised")
    each = conditions.groupBy("condition").agg(
        F.bool_or("detected").alias("some"), F.countDistinct(F.when(known & F.col("detected"), F.col("variant"))).alias("known"), F.min("base_accuracy").alias("base"), F.max("base_accuracy").alias("base_most"), F.bool_and(F.col("accuracy") > F.col("base_accuracy")).alias("gains")
    )
    control = F.col("condition") == "control"
    s = each.agg(
        F.count_if(control).alias("controls"), F.coalesce(F.bool_and(F.when(control, ~F.col("some"))), F.lit(False)).alias("control_clean"), F.coalesce(F.bool_and(F.when(~control, F.col("known") == 2)), F.lit(False)).alias("treated_detected"),
        (F.min("base") == F.max("base_most")).alias("one_base"), F.bool_and("gains").alias("all_gain"),
    )
    return s.withColumn("passed", F.coalesce(F.col("control_clean") & F.col("treated_detected") & F.col("one_base") & F.col("all_gain"), F.lit(False)))


def metric_with_teacher(metrics: DataFrame, teachers: DataFrame) -> DataFrame:
    """Metrics (method, variant, ...) with the teacher's row (method, kind, ...): of alternative traces for unsupervised variants, else of training ones."""
    kind = F.when(F.col("variant").endswith("_unsupervised"), "alternative_traces").otherwise("training_traces")
    return metrics.withColumn("kind", kind).join(teachers, ["method", "kind"])


def only_tag(value: Column) -> Column:
    """Aggregate: the value of a group that has only one, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def empty_rows(rows: DataFrame, column: str, index: str, most: int = 10) -> DataFrame:
    """One row: how many rows have an empty or no ``column``, and the first indices of them."""
    bad = rows.where(F.coalesce(column, F.lit("")) == "").select(index)
    first = bad.orderBy(index).limit(most).agg(F.array_join(F.array_sort(F.collect_list(index)).cast("array<string>"), ",").alias("first"))
    return bad.agg(F.count("*").alias("n")).join(F.broadcast(first))  # one row each


def vocabulary_join(source: DataFrame, target: DataFrame, size: int | None = None) -> DataFrame:
    """(id, target): each source token's (id, token) least target id of the same string, or null; ids from ``size`` on do not count."""
    held = target if size is None else target.where(F.col("id") < size)
    return source.join(held.groupBy("token").agg(F.min("id").alias("target")), "token", "left").select("id", "token", "target")


def identical_vocabularies(mapping: DataFrame) -> bool:
    """Whether every token maps to its own id, so that a join by the mapping can be left out."""
    return bool(mapping.agg(F.coalesce(F.bool_and(F.coalesce(F.col("target") == F.col("id"), F.lit(False))), F.lit(True))).first()[0])


def remapped(rows: DataFrame, mapping: DataFrame, token: str = "token_id", missing: int = -1) -> DataFrame:
    """``rows`` with ``token`` replaced by its target id, ``missing`` without one; as they are where the vocabularies are the same."""
    if identical_vocabularies(mapping):
        return rows
    m = mapping.select(F.col("id").alias("m_id"), F.col("target").alias("m_target"))
    return rows.join(m, F.col(token) == F.col("m_id"), "left").withColumn(token, F.coalesce("m_target", F.lit(missing))).drop("m_id", "m_target")


def selected_tokens(candidates: DataFrame, group: str) -> DataFrame:
    """The chosen candidate of each group: (token, p, score_a, score_b, use_a), the greatest log score over probability, ties to the first token."""
    routed = F.when(F.col("use_a"), F.col("score_a")).otherwise(F.col("score_b"))
    value = F.ln(routed + F.lit(1e-30)) / (F.col("p") + F.lit(1e-30))
    return candidates.groupBy(group).agg(F.max_by("token", F.struct(value, -F.col("token"))).alias("token"))
