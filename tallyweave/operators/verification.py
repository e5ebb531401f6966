"""Verification of a summary of runs: every cell against its raw metric, every condition against its gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import stats

VARIANTS = ("open_supervised", "closed_supervised", "open_unsupervised", "closed_unsupervised")
#: What a summary's cell must share with the raw metric.
SHARED = ("mean", "num_measurements", "seed", "trace_examples", "trace_file")


def verified_cells(summary: DataFrame, raw: DataFrame, conditions: list[str], expected: dict[str, tuple[int, int]], gamma: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """A row for each cell that must be there: (condition, variant, detects, problem).

    ``summary`` has condition, variant, ``SHARED``, p_value and detected; ``raw`` condition, variant and ``SHARED``. ``expected`` gives the seed and the number of
    trace examples for ``supervised`` and ``unsupervised`` variants. ``problem`` is the first of missing_cell, missing_metric, {column}_differs,
    unexpected_seed, unexpected_examples, mean_not_finite, tail_differs (by 1e-12), verdict_differs; null if none. A cell that comes twice gives a row each time.
    """
    spark = summary.sparkSession
    cells = [(c, v, *expected[v.split("_", 1)[1]]) for c in conditions for v in VARIANTS]
    grid = spark.createDataFrame(cells, "condition string, variant string, e_seed long, e_examples long")
    theirs = raw.select("condition", "variant", *(F.col(c).alias(f"raw_{c}") for c in SHARED), F.lit(True).alias("has_raw"))
    both = grid.join(summary.withColumn("has_own", F.lit(True)), ["condition", "variant"], "left").join(theirs, ["condition", "variant"], "left")
    tail = stats.hoeffding(F.col("mean"), F.col("num_measurements"), gamma)
    finite = F.col("mean").isNotNull() & ~F.isnan("mean") & (F.abs("mean") < float("inf"))
    problem = F.when(F.col("has_own").isNull(), "missing_cell").when(F.col("has_raw").isNull(), "missing_metric")
    for c in SHARED:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"raw_{c}")), f"{c}_differs")
    problem = problem.when(~F.col("seed").eqNullSafe(F.col("e_seed")), "unexpected_seed").when(~F.col("trace_examples").eqNullSafe(F.col("e_examples")), "unexpected_examples").when(~finite, "mean_not_finite")
    problem = problem.when(~F.coalesce(F.abs(F.col("p_value") - tail) < 1e-12, F.lit(False)), "tail_differs").when(~F.col("detected").eqNullSafe(tail < alpha), "verdict_differs")
    return both.select("condition", "variant", F.coalesce(tail < alpha, F.lit(False)).alias("detects"), problem.alias("problem"))


def verified_conditions(cells: DataFrame, utility: DataFrame, samples: int) -> DataFrame:
    """A row for each condition of ``verified_cells``: (condition, gain, problem).

    ``utility`` has condition, samples, accuracy, candidate_accuracy, base_accuracy and passed. ``problem`` is the first of bad_cells, missing_utility, wrong_samples,
    accuracy_differs, gate_failed, no_gain, control_detected, known_not_detected (one of the two supervised variants), base_differs (from another condition's); null if none.
    """
    each = cells.groupBy("condition").agg(F.count("problem").alias("bad"), F.bool_or("detects").alias("some"), F.bool_and(F.when(~F.col("variant").endswith("_unsupervised"), F.col("detects"))).alias("known"))
    bases = utility.agg(F.countDistinct("base_accuracy").alias("bases"))
    both = each.join(utility, "condition", "left").join(F.broadcast(bases))  # one row
    problem = (
        F.when(F.col("bad") > 0, "bad_cells").when(F.col("samples").isNull(), "missing_utility").when(F.col("samples") != samples, "wrong_samples")
        .when(~F.col("accuracy").eqNullSafe(F.col("candidate_accuracy")), "accuracy_differs").when(~F.coalesce("passed", F.lit(False)), "gate_failed")
        .when(~F.coalesce(F.col("accuracy") > F.col("base_accuracy"), F.lit(False)), "no_gain").when((F.col("condition") == "control") & F.col("some"), "control_detected")
        .when((F.col("condition") != "control") & ~F.col("known"), "known_not_detected").when(F.col("bases") != 1, "base_differs")
    )
    return both.select("condition", (F.col("accuracy") - F.col("base_accuracy")).alias("gain"), problem.alias("problem"))
