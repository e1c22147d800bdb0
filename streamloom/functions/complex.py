"""Complex numbers as struct(re, im) expressions. There is no quotient of two complex numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def complex_of(re: Number, im: Number = 0.0) -> Column:
    """re + im i of two real numbers."""
    part = lambda x: (x if isinstance(x, Column) else F.lit(float(x))).cast("double")
    return F.struct(part(re).alias("re"), part(im).alias("im"))


def polar(size: Number, angle: Number) -> Column:
    size, angle = (x if isinstance(x, Column) else F.lit(float(x)) for x in (size, angle))
    return complex_of(size * F.cos(angle), size * F.sin(angle))


def add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def multiply(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def scale(a: Column, k: Number) -> Column:
    """A complex number times a real one; over k by scale(a, 1 / k)."""
    return complex_of(a["re"] * k, a["im"] * k)


def negative(a: Column) -> Column:
    return complex_of(-a["re"], -a["im"])


def absolute(a: Column) -> Column:
    return F.sqrt(a["re"] * a["re"] + a["im"] * a["im"])


def angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def complex_sine(k: Column, n: int, reverse: bool = False) -> Column:
    """exp(-2 pi i k x / n) for x from 0 to n - 1, with + if reverse."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: polar(F.lit(1.0), F.lit((2 if reverse else -2) * 3.141592653589793 / n) * k * x))


def dft(x: Column, n: int, reverse: bool = False) -> Column:
    """The discrete Fourier transform of the first n elements of an array of complex numbers, term by term (n * n steps); reverse: the
    inverse transform, over n. Elements that are missing count as 0."""

    def one(k: Column) -> Column:
        terms = F.zip_with(F.slice(x, F.lit(1), F.lit(n)), complex_sine(k, n, reverse), lambda a, s: multiply(F.coalesce(a, complex_of(0.0)), s))
        total = F.aggregate(terms, complex_of(0.0), lambda t, a: complex_of(t["re"] + a["re"], t["im"] + a["im"]))
        return scale(total, 1.0 / n) if reverse else total

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)
