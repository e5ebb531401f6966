"""The keyed integer hash of (previous, current, token) and set membership by it, in wrapping 64-bit arithmetic.

ANSI mode refuses a product over 64 bits, so products are taken from 16- and 32-bit limbs, all in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The multipliers of the hash.
M1, M2, M3 = 6364136223846793005, 1442695040888963407, 22695477
LOW32, LOW16 = (1 << 32) - 1, (1 << 16) - 1
MAX63 = (1 << 63) - 1


@dataclass(frozen=True)
class HashKey:
    """A seed (taken modulo 2^63) and the share of the vocabulary in the set, strictly between 0 and 1."""

    seed: int = 294288
    gamma: float = 0.5

    def __post_init__(self) -> None:
        if not 0 < self.gamma < 1:
            raise ValueError("gamma must lie strictly between 0 and 1")
        object.__setattr__(self, "seed", self.seed % (1 << 63))


def wrapped_product(a: Column, m: int) -> Column:
    """``a * m`` modulo 2^64 as a signed 64-bit integer; ``a`` should be a plain column, it is used often."""
    m_low, m_high = m & LOW32, (m >> 32) & LOW32
    mask = lambda x: x.bitwiseAND(F.lit(LOW32))
    low, high = mask(a), mask(F.shiftrightunsigned(a, 32))

    def part(x: Column, y: int) -> tuple[Column, Column]:  # x * y from x's halves: below 2^48 each
        return x.bitwiseAND(F.lit(LOW16)) * F.lit(y), F.shiftrightunsigned(x, 16) * F.lit(y)

    p, q = part(low, m_low)
    bottom = p + F.shiftleft(q.bitwiseAND(F.lit(LOW16)), 16)
    top = F.shiftrightunsigned(q, 16) + F.shiftrightunsigned(bottom, 32)
    for x, y in ((high, m_low), (low, m_high)):
        p, q = part(x, y)
        top = top + mask(p) + F.shiftleft(q.bitwiseAND(F.lit(LOW16)), 16)
    return F.shiftleft(mask(top), 32).bitwiseOR(mask(bottom))


def with_hash(df: DataFrame, prev: str, cur: str, token: str, key: HashKey, out: str = "x", seed: str | None = None) -> DataFrame:
    """Add the 63-bit hash of each row, with the key's seed or the column ``seed``; column by column, so that no step is computed twice."""
    long = lambda c: F.col(c).cast("long")
    df = df.withColumns({"h_t": long(token), "h_p": long(prev), "h_c": long(cur)})
    df = df.withColumn("h_x", wrapped_product(F.col("h_t"), M1).bitwiseXOR(wrapped_product(F.col("h_p"), M2)).bitwiseXOR(wrapped_product(F.col("h_c"), M3)).bitwiseXOR(F.lit(key.seed) if seed is None else F.col(seed)))
    df = df.withColumn("h_x", F.col("h_x").bitwiseXOR(F.shiftright("h_x", 30)))
    df = df.withColumn("h_x", wrapped_product(F.col("h_x"), M2))
    df = df.withColumn("h_x", F.col("h_x").bitwiseXOR(F.shiftright("h_x", 27)))
    df = df.withColumn("h_x", wrapped_product(F.col("h_x"), M3))
    df = df.withColumn(out, F.col("h_x").bitwiseXOR(F.shiftright("h_x", 31)).bitwiseAND(F.lit(MAX63)))
    return df.drop("h_t", "h_p", "h_c", "h_x")


def in_set(x: Column, key: HashKey, token: Column | None = None, excluded: tuple[int, ...] = ()) -> Column:
    """Whether a hash falls in the set; excluded tokens never do."""
    below = x < F.lit((1 << 62) - 256) if key.gamma == 0.5 else x.cast("double") / F.lit(float(1 << 63)) < F.lit(key.gamma)
    return below & ~token.isin(*excluded) if excluded else below


def token_id(word: Column, vocabulary: int = 151936) -> Column:
    """Stand-in for a tokenizer: an id from the word's md5."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long") % vocabulary
