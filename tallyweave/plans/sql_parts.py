"""SQL that several oracles share."""

from __future__ import annotations

from tallyweave.functions import keyed_hash

KEY = keyed_hash.HashKey()


def wrap(x: str) -> str:
    """SQL: a 128-bit integer as a wrapped signed 64-bit one."""
    m = f"(((({x}) % 18446744073709551616::HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)"
    return f"(CASE WHEN {m} >= 9223372036854775808::HUGEINT THEN {m} - 18446744073709551616::HUGEINT ELSE {m} END)::BIGINT"


def hash_steps(source: str, columns: str, seed: str = str(KEY.seed)) -> str:
    """SQL: common table expressions that add ``x``, the 63-bit hash of (prev, cur, token), to ``source``."""
    mul = lambda a, m: wrap(f"{a}::HUGEINT * {m}::HUGEINT")
    return f"""
      k1 AS (SELECT {columns}, xor(xor(xor({mul('token', keyed_hash.M1)}, {mul('prev', keyed_hash.M2)}), {mul('cur', keyed_hash.M3)}), {seed}) AS x FROM {source}),
      k2 AS (SELECT * REPLACE (xor(x, x >> 30) AS x) FROM k1), k3 AS (SELECT * REPLACE ({mul('x', keyed_hash.M2)} AS x) FROM k2),
      k4 AS (SELECT * REPLACE (xor(x, x >> 27) AS x) FROM k3), k5 AS (SELECT * REPLACE ({mul('x', keyed_hash.M3)} AS x) FROM k4),
      hashed AS (SELECT * REPLACE (xor(x, x >> 31) & 9223372036854775807 AS x) FROM k5)"""


ID = "(('0x' || substr(md5({w}), 1, 15))::BIGINT % 151936)"
TOKENS = f"""
      words AS (SELECT doc_id AS id, string_split(lower(text), ' ') AS ws FROM documents),
      places AS (SELECT id, ws, unnest(range(len(ws))) AS pos FROM words),
      toks AS (SELECT id, pos, {ID.format(w="ws[pos + 1]")} AS token FROM places)"""
BIGRAMS = f"""{TOKENS},
      grams AS (SELECT * FROM (SELECT id, pos, coalesce(lag(token) OVER (PARTITION BY id ORDER BY pos), -1) AS prev, token AS cur,
        lead(token) OVER (PARTITION BY id ORDER BY pos) AS token FROM toks) WHERE token IS NOT NULL)"""
HIT = "x < 4611686018427387648"


def hoeffding(mean: str, n: str, gamma: str = "0.5") -> str:
    return f"CASE WHEN {n} <= 0 OR {mean} <= {gamma} THEN 1.0::DOUBLE ELSE greatest(1e-300::DOUBLE, exp(-2 * {n} * ({mean} - {gamma}) * ({mean} - {gamma}))) END"


#: SQL: tail (a, x, p) of the rows of ``q`` with shape a and point x, by the power series; needs WITH RECURSIVE.
GAMMA_Q = """terms AS (SELECT a, x, 1 AS k, 1 / a AS term, 1 / a AS total FROM (SELECT DISTINCT a, x FROM q WHERE x > 0 AND a > 0)
        UNION ALL SELECT a, x, k + 1, term * x / (a + k), total + term * x / (a + k) FROM terms WHERE term > total * 1e-17),
      tail AS (SELECT a, x, greatest(0, 1 - max(total) * exp(a * ln(x) - x - lgamma(a))) AS p FROM terms GROUP BY a, x UNION ALL SELECT DISTINCT a, x, 1.0 FROM q WHERE x <= 0 OR a <= 0)"""
