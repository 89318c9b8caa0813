"""Small integer functions: powers of two, masks, trailing zeros."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_pow2(n: int) -> int:
    """The smallest power of two that is at least n; 1 for 0."""
    return 1 << max(0, n - 1).bit_length()


def next_pow2_column(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))).cast("bigint")


def mask(n: Column, modulus: Column | int) -> Column:
    """n modulo a power of two."""
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    return n.bitwiseAND(m - 1).cast("bigint")


def trailing_zeros(n: Column) -> Column:
    return F.bit_count(n.bitwiseAND(-n) - 1)


def half_up(x: float) -> int:
    return math.floor(x + 0.5)
