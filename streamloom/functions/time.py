"""Lengths of time in nanoseconds, and their relation to sample counts at a rate."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import total_ordering

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of each unit.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}


def rate_of(rate: float) -> float:
    """A sample rate as a 32-bit float widened to 64 bits."""
    return float(np.float32(rate))


@total_ordering
@dataclass(frozen=True, eq=False)
class TimeMeasure:
    """A whole number of units."""

    time: int
    unit: str = "ms"

    @property
    def ns(self) -> int:
        return self.time * UNITS[self.unit]

    def to(self, unit: str) -> int:
        """In another unit, truncated toward zero."""
        return int(math.copysign(abs(self.ns) // UNITS[unit], self.ns)) if self.ns else 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, TimeMeasure) and self.ns == other.ns

    def __hash__(self) -> int:
        return hash(self.ns)

    def __lt__(self, other: TimeMeasure) -> bool:
        return self.ns < other.ns

    def __add__(self, other: TimeMeasure) -> TimeMeasure:
        return TimeMeasure(self.ns + other.ns, "ns")

    def __sub__(self, other: TimeMeasure) -> TimeMeasure:
        return TimeMeasure(self.ns - other.ns, "ns")

    @staticmethod
    def parse_or_none(text: str) -> TimeMeasure | None:
        """A number and a unit; what follows a decimal point is dropped."""
        m = re.fullmatch(r"\s*(-?\d+)(?:\.\d+)?\s*(ns|us|ms|s|m|h|d)?\s*", text.lower())
        return TimeMeasure(int(m[1]), m[2] or "s") if m and m[2] else None

    @staticmethod
    def parse(text: str) -> TimeMeasure:
        found = TimeMeasure.parse_or_none(text)
        if found is None:
            raise ValueError(f"not a length of time: {text!r}")
        return found


def samples_to_time(n: int, rate: float, unit: str = "ms") -> int:
    """Length of n samples, truncated."""
    return int(n / (rate_of(rate) / (1e9 / UNITS[unit])))


def index_floor(ns: int, rate: float) -> int:
    return math.floor(ns / 1e9 * rate_of(rate))


def index_ceil(ns: int, rate: float) -> int:
    return math.ceil(ns / 1e9 * rate_of(rate))


def time_of(n: Column, rate: float, unit: str = "ms") -> Column:
    """samples_to_time() of a column."""
    return (n / (F.lit(rate_of(rate)) / F.lit(1e9 / UNITS[unit]))).cast("long")


def floor_of(ns: Column, rate: float) -> Column:
    """index_floor() of a column."""
    return F.floor(ns / F.lit(1e9) * F.lit(rate_of(rate))).cast("long")


def ceil_of(ns: Column, rate: float) -> Column:
    """index_ceil() of a column."""
    return F.ceil(ns / F.lit(1e9) * F.lit(rate_of(rate))).cast("long")


def parse_ns(text: Column) -> Column:
    """Nanoseconds of lengths of time as TimeMeasure.parse_or_none() takes them; null for others."""
    shape = r"^\s*(-?[0-9]+)(?:\.[0-9]+)?\s*(ns|us|ms|s|m|h|d)\s*$"
    low = F.lower(text)
    factors = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.when(low.rlike(shape), F.regexp_extract(low, shape, 1).cast("long") * F.element_at(factors, F.nullif(F.regexp_extract(low, shape, 2), F.lit(""))))
