"""The library's functions for SQL text: session functions that Spark inlines into the plan, nothing runs in Python.

After ``register(spark)``: ``keyed_hash(prev, cur, token, seed)``, ``green(prev, cur, token, seed)``, ``last_choice(answer)``, ``last_boxed(answer)``,
``gamma_q(shape, x)``, ``hoeffding(mean, n, gamma)`` and the table function ``ngrams(tokens, n)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyweave.functions.keyed_hash import LOW16, LOW32, M1, M2, M3, MAX63
from tallyweave.functions.stats import _LANCZOS, FLOOR
from tallyweave.functions.text import BOXED, SAID


def _product(m: int) -> str:
    """SQL of ``a * m`` modulo 2^64, signed, from 32- and 16-bit limbs."""
    low, high = m & LOW32, (m >> 32) & LOW32
    part = lambda x, y: f"(({x} & {LOW16}) * {y}L + shiftleft((shiftrightunsigned({x}, 16) * {y}L) & {LOW16}L, 16))"
    a_low, a_high = f"(a & {LOW32}L)", "shiftrightunsigned(a, 32)"
    bottom = part(a_low, low)
    top = f"(shiftrightunsigned(shiftrightunsigned({a_low}, 16) * {low}L, 16) + shiftrightunsigned({bottom}, 32)"
    for x, y in ((a_high, low), (a_low, high)):
        top += f" + (({x} & {LOW16}) * {y}L & {LOW32}L) + shiftleft((shiftrightunsigned({x}, 16) * {y}L) & {LOW16}L, 16)"
    return f"shiftleft({top}) & {LOW32}L, 32) | ({bottom} & {LOW32}L)"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql`` for this session; again replaces them."""
    lanczos = " + ".join([f"{_LANCZOS[0]!r}D", *(f"{c!r}D / (a + {i + 1}D)" for i, c in enumerate(_LANCZOS[1:]))])
    bodies = {
        "wrapped_m1(a BIGINT) RETURNS BIGINT": _product(M1),
        "wrapped_m2(a BIGINT) RETURNS BIGINT": _product(M2),
        "wrapped_m3(a BIGINT) RETURNS BIGINT": _product(M3),
        # a step's argument is bound by a lambda: written out, each would multiply the ones before
        "mixed_30(x BIGINT) RETURNS BIGINT": f"get(transform(transform(array(x), a -> a ^ shiftright(a, 30)), a -> {_product(M2)}), 0)",
        "mixed_27(x BIGINT) RETURNS BIGINT": f"get(transform(transform(array(x), a -> a ^ shiftright(a, 27)), a -> {_product(M3)}), 0)",
        "mixed_31(x BIGINT) RETURNS BIGINT": f"get(transform(array(x), a -> (a ^ shiftright(a, 31)) & {MAX63}L), 0)",
        "keyed_hash(prev BIGINT, cur BIGINT, token BIGINT, seed BIGINT) RETURNS BIGINT": "mixed_31(mixed_27(mixed_30(wrapped_m1(token) ^ wrapped_m2(prev) ^ wrapped_m3(cur) ^ seed)))",
        "green(prev BIGINT, cur BIGINT, token BIGINT, seed BIGINT) RETURNS BOOLEAN": f"keyed_hash(prev, cur, token, seed) < {(1 << 62) - 256}L",
        "last_boxed(answer STRING) RETURNS STRING": f"upper(try_element_at(regexp_extract_all(answer, {_literal(BOXED)}, 1), -1))",
        "last_choice(answer STRING) RETURNS STRING": f"coalesce(last_boxed(answer), upper(try_element_at(regexp_extract_all(answer, {_literal(SAID)}, 1), -1)))",
        "hoeffding(mean DOUBLE, n BIGINT, gamma DOUBLE) RETURNS DOUBLE": f"CASE WHEN n <= 0 OR mean <= gamma THEN 1D WHEN mean IS NOT NULL AND n IS NOT NULL THEN greatest({FLOOR!r}D, exp(-2 * n * (mean - gamma) * (mean - gamma))) END",
        "log_gamma(a DOUBLE) RETURNS DOUBLE": f"0.5D * ln(2 * pi()) + (a + 0.5D) * ln(a + 7.5D) - (a + 7.5D) + ln({lanczos}) - ln(a)",
        "gamma_q(shape DOUBLE, x DOUBLE) RETURNS DOUBLE": """CASE WHEN shape IS NULL OR x IS NULL THEN NULL WHEN x <= 0 THEN 1D
            WHEN x < shape + 1 THEN greatest(0D, 1 - exp(shape * ln(x) - x - log_gamma(shape)) * aggregate(sequence(1, CAST(80 + 10 * sqrt(greatest(shape, x)) AS INT)), named_struct('term', 1 / shape, 'sum', 1 / shape),
              (s, k) -> named_struct('term', s.term * x / (shape + k), 'sum', s.sum + s.term * x / (shape + k)), s -> s.sum))
            ELSE exp(shape * ln(x) - x - log_gamma(shape)) * aggregate(sequence(1, CAST(80 + 10 * sqrt(shape) AS INT)), named_struct('c', 1E300D, 'd', 1 / (x + 1 - shape), 'h', 1 / (x + 1 - shape)),
              (s, i) -> named_struct('c', x + 1 - shape + 2 * i - i * (i - shape) / s.c, 'd', 1 / (-i * (i - shape) * s.d + x + 1 - shape + 2 * i), 'h', s.h * (x + 1 - shape + 2 * i - i * (i - shape) / s.c) / (-i * (i - shape) * s.d + x + 1 - shape + 2 * i)), s -> s.h) END""",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION ngrams(tokens ARRAY<BIGINT>, n INT) RETURNS TABLE(pos INT, context ARRAY<BIGINT>, target BIGINT)
        RETURN SELECT p, slice(tokens, p - n + 1, n), get(tokens, p) FROM (SELECT explode(CASE WHEN size(tokens) > n + 1 THEN sequence(n + 1, size(tokens) - 1) ELSE CAST(array() AS ARRAY<INT>) END) AS p)"""
    )
