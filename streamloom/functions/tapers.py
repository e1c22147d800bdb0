"""Window functions (tapers): weight of element i of n, as column expressions. They divide by n, not n - 1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rectangle(i: Column, n: Column) -> Column:
    return F.lit(1.0)


def triangular(i: Column, n: Column) -> Column:
    half = n.cast("double") / 2.0
    return F.lit(1.0) - F.abs((i - half) / half)


def blackman(i: Column, n: Column) -> Column:
    x = F.lit(2.0 * math.pi) * i / n
    return F.lit(0.42) - F.lit(0.5) * F.cos(x) + F.lit(0.08) * F.cos(x * 2.0)


def hamming(i: Column, n: Column) -> Column:
    a0 = 25.0 / 46.0
    return F.lit(a0) - F.lit(1.0 - a0) * F.cos(F.lit(2.0 * math.pi) * i / n)


TAPERS = {"rectangle": rectangle, "triangular": triangular, "blackman": blackman, "hamming": hamming}
