"""Random numbers and seeds that are functions of a key, not of row order.

A task that is retried on another executor draws the same numbers again, and so does a
plain SQL engine that evaluates the same md5 expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
SEED_MODULUS = 4294967295  # 2**32 - 1


def uniform(*parts: Column | str) -> Column:
    """Uniform draw in [0, 1) from the md5 of the parts joined by ``|``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def normal(u1: Column, u2: Column, mean: Column, std: Column) -> Column:
    """Normal draw from two uniform draws (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1))
    return mean + std * radius * F.cos(F.lit(6.283185307179586) * u2)


def race(u: Column, weight: Column) -> Column:
    """Arrival time of an exponential race: the smallest one wins with odds by weight."""
    return F.when(weight > 0, -F.log(F.lit(1.0) - u) / weight)


def seed_from_name(name: Column | str) -> Column:
    """SHA-256 of the name as one big integer, modulo 2**32 - 1.

    2**32 is 1 modulo 2**32 - 1, so the digest reduces to the sum of its eight 32-bit words.
    """
    digest = F.sha2(F.col(name) if isinstance(name, str) else name, 256)
    words = [
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)
    ]
    total = words[0]
    for word in words[1:]:
        total = total + word
    return F.pmod(total, F.lit(SEED_MODULUS))
