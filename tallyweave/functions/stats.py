"""Significance tests over columns, and the exact tails that Spark lacks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-300


def hoeffding(mean: Column, n: Column, gamma: Column | float) -> Column:
    """One-sided tail of a mean over its expectation; 1 if it isn't over or nothing was measured, null for a null mean or count."""
    g = F.lit(gamma) if isinstance(gamma, float) else gamma
    p = F.greatest(F.lit(FLOOR), F.exp(-2 * n * (mean - g) * (mean - g)))
    return F.when((n <= 0) | (mean <= g), F.lit(1.0)).when(mean.isNotNull() & n.isNotNull(), p)


def upper_gamma(shape: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(shape, x)."""
    if x <= 0:
        return 1.0
    scale = shape * math.log(x) - x - math.lgamma(shape)
    if x < shape + 1:  # series for the lower part
        term = total = 1 / shape
        k = shape
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(scale))
    b = x + 1 - shape  # continued fraction
    c, d = 1e300, 1 / b
    h, i = d, 0
    while True:
        i += 1
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15 or i > 10_000_000:
            return math.exp(scale) * h if scale > -745 else 0.0


# Lanczos' coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(a: Column) -> Column:
    """ln of the gamma function of positive numbers, to about 14 digits."""
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        total = total + F.lit(c) / (a + F.lit(float(i + 1)))
    t = a + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (a + 0.5) * F.log(t) - t + F.log(total) - F.log(a)


def gamma_q(shape: Column, x: Column) -> Column:
    """Q(shape, x) for positive shapes, in the JVM; null in, null out.

    Below shape + 1 one less the power series, else the continued fraction, folded over a fixed number of terms: 80 + 10 * sqrt(shape) (and, for the
    series, of x) leave an error below 1e-12 of the sum, since about the largest term the terms fall off as a normal density of that width does.
    """
    shape, x = shape.cast("double"), x.cast("double")
    steps = lambda v: F.sequence(F.lit(1), (F.lit(80) + 10 * F.sqrt(v)).cast("int"))

    def series(a: Column, z: Column, scale: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            term = s["term"] * z / (a + k)
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

        return 1 - scale * F.aggregate(steps(F.greatest(a, z)), F.struct((1 / a).alias("term"), (1 / a).alias("sum")), one, lambda s: s["sum"])

    def fraction(a: Column, z: Column, scale: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            c = -i * (i - a)
            base = z + 1 - a + 2 * i
            d, f = 1 / (c * s["d"] + base), base + c / s["c"]
            return F.struct(f.alias("c"), d.alias("d"), (s["h"] * d * f).alias("h"))

        start = 1 / (z + 1 - a)
        return scale * F.aggregate(steps(a), F.struct(F.lit(1e300).alias("c"), start.alias("d"), start.alias("h")), one, lambda s: s["h"])

    scale = F.exp(shape * F.log(x) - x - log_gamma(shape))
    lower = F.greatest(F.lit(0.0), series(shape, x, scale))
    return F.when(shape.isNull() | x.isNull(), F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)).when(x < shape + 1, lower).otherwise(fraction(shape, x, scale))


def _half_tail(least: int, n: int) -> float:
    """Probability of ``least`` or more of ``n`` fair coins; exact up to 1000 of them, else by the incomplete beta function."""
    if n <= 1000:
        return sum(math.comb(n, k) for k in range(least, n + 1)) / (1 << n)
    a, b = least, n - least + 1  # I_1/2(a, b); its continued fraction converges fast for a > b, as here
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - (a + b) * math.log(2.0)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * 0.5 / (a + 1) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for term in (m * (b - m) * 0.5 / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d or tiny), 1 + term / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14 or m > 1_000_000:
            return min(1.0, front * out)


def mcnemar(improved: int, regressed: int) -> float:
    """One-sided tail of discordant pairs; 1 if there are none or no more improved."""
    if improved <= regressed:
        return 1.0
    return _half_tail(improved, improved + regressed)


def mcnemar_tail(improved: Column, regressed: Column) -> Column:
    """``mcnemar`` for columns, in Arrow batches; null in, null out."""
    import types

    scope = {"math": math, "__builtins__": __builtins__}
    scope["_half_tail"] = types.FunctionType(_half_tail.__code__, scope, "tail")
    tail = types.FunctionType(mcnemar.__code__, scope, "tail")

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(i) or pd.isna(j) else tail(int(i), int(j)) for i, j in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")(improved, regressed)


def unweighted_gamma(n: Column, score_sum: Column, alpha: float) -> Column:
    """Struct (mean, p_value, strength, detected) of ``n`` scores with a sum, for a mixing share ``alpha``; nothing is detected in none."""
    base = alpha * alpha + (1 - alpha) * (1 - alpha)
    p = F.when(n == 0, F.lit(1.0)).otherwise(gamma_q(n / F.lit(base), score_sum / F.lit(base)))
    mean = F.when(n == 0, F.lit(0.0)).otherwise(score_sum / F.nullif(n, F.lit(0)))
    return F.struct(mean.alias("mean"), p.alias("p_value"), minus_log10(p).alias("strength"), (p < 0.01).alias("detected"))


def passes_gate(gain: Column, p_value: Column, least_gain: float = 0.0, alpha: float = 0.05) -> Column:
    """Whether a gain is large and sure enough; null measures (no samples) do not pass."""
    return F.coalesce((gain > least_gain) & (p_value <= alpha), F.lit(False))


def minus_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(FLOOR)))


def mean_and_margin(value: Column) -> tuple[Column, Column]:
    """Mean and 1.96 standard errors (sample deviation)."""
    return F.avg(value), 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
