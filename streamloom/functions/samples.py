"""Sample and sample-vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest values of signed integers by bits.
MAX = {8: 0x7F, 16: 0x7FFF, 24: 0x7FFFFF, 32: 0x7FFFFFFF, 64: 0x7FFFFFFFFFFFFFFF}
ZERO = 0.0


def sample_of(value: Column, bits: int) -> Column:
    """An integer of so many bits as a sample between -1 and 1."""
    return value.cast("double") / F.lit(float(MAX[bits]))


def as_int(sample: Column, bits: int) -> Column:
    """A sample as an integer of so many bits: rounded half to even; 8, 16 and 24 bits wrap, 32 and 64 saturate; NaN is 0."""
    scaled = F.rint(F.nanvl(F.coalesce(sample, F.lit(0.0)), F.lit(0.0)) * F.lit(float(MAX[bits])))
    top = float(MAX[64 if bits == 64 else 32])
    whole = F.when(scaled >= top, F.lit(int(MAX[64 if bits == 64 else 32]))).when(scaled <= -top - 1, F.lit(-int(MAX[64 if bits == 64 else 32]) - 1)).otherwise(F.least(F.greatest(scaled, F.lit(-top)), F.lit(top - 1024 if bits == 64 else top)).cast("long"))
    if bits in (8, 16, 24):
        half = 1 << (bits - 1)
        return (F.pmod(whole + half, F.lit(2 * half)) - half).cast("long")
    return whole.cast("long")


def as_unsigned_byte(sample: Column) -> Column:
    """The offset-binary byte of a sample, 0 to 255."""
    return F.pmod(as_int(sample, 8), F.lit(256)).bitwiseXOR(F.lit(0x80).cast("long"))


def divide(x: Column, y: Column) -> Column:
    """IEEE division: x / 0 is infinite or NaN, never an error."""
    zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(y == 0, zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def rounded(x: Column, digits: int) -> Column:
    """A number with so many digits after the point, as SQL's engines in C round it: x times a power of ten, in doubles, half away from zero.
    F.round rounds the shortest decimal text of x instead, so that 0.0640625 with six digits is 0.064063 there and 0.064062 here."""
    scale = F.lit(10.0**digits)
    scaled = x * scale
    near = F.rint(scaled)
    found = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / scale
    return F.when(F.isnan(found) | (F.abs(found) == float("inf")), x).otherwise(found)


def combine(x: Column, y: Column, op: str) -> Column:
    """x op y for + - * /, with an absent operand as 0; a quotient without a right operand is 0."""
    a, b = F.coalesce(x, F.lit(ZERO)), F.coalesce(y, F.lit(ZERO))
    if op == "/":
        return F.when(y.isNull(), F.lit(ZERO)).otherwise(divide(a, b))
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def vector_combine(x: Column, y: Column, op: str) -> Column:
    """Element by element over the longer length with 0 for what is missing; both null: null."""
    empty = F.array().cast("array<double>")

    def one(a: Column, b: Column) -> Column:
        a, b = F.coalesce(a, F.lit(ZERO)), F.coalesce(b, F.lit(ZERO))
        return {"+": a + b, "-": a - b, "*": a * b, "/": divide(a, b)}[op]

    return F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.zip_with(F.coalesce(x, empty), F.coalesce(y, empty), one))


def vector_scalar(x: Column, k: float, op: str, scalar_first: bool = False) -> Column:
    """Vector and number, in either order."""

    def one(a: Column) -> Column:
        left, right = (F.lit(float(k)), a) if scalar_first else (a, F.lit(float(k)))
        return {"+": left + right, "-": left - right, "*": left * right, "/": divide(left, right)}[op]

    return F.transform(x, one)


def vector_of(*values: Column | float) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(float(v)) for v in values))


def vector_from(size: int, fn) -> Column:
    """A vector of fn(position)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: fn(i).cast("double"))


def vector_window(x: Column, step: int | None = None) -> Column:
    """A vector as a window of its length; step: that of the windows' grid, the length by default."""
    size = F.size(x)
    return F.struct(size.alias("size"), (size if step is None else F.lit(step)).alias("step"), x.alias("elements"))
