"""Lazy ordered streams over DataFrames.

A Stream is a plan: build(context) makes a DataFrame of idx (dense, from 0) and value. The sample rate is bound when the
plan is built. `bound` tells a plan how many elements its consumer needs, so that endless sources become finite ranges.
Everything after that is Catalyst's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions import samples, tapers
from streamloom.functions.time import UNITS, TimeMeasure, index_ceil, index_floor, rate_of
from streamloom.operators import indexing, resample, sequences, spectral, windows


@dataclass(frozen=True)
class Context:
    """What a plan is built for: a session, a rate in Hz, and the number of elements needed (None: all)."""

    spark: SparkSession
    rate: float
    bound: int | None = None

    def need(self, bound: int | None) -> Context:
        return replace(self, bound=bound)


def _both(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _ns(length: int | TimeMeasure, unit: str) -> int:
    return length.ns if isinstance(length, TimeMeasure) else int(length) * UNITS[unit]


class Stream:
    """An ordered stream; see the module."""

    def __init__(self, make: Callable[[Context], DataFrame], rate: float | None = None, finite: bool = True, measure: int = 1, kind: str = "sample", grid: tuple[int, int] | None = None):
        self.make, self.rate, self.finite, self.measure, self.kind, self.grid = make, rate, finite, measure, kind, grid

    # -- sources -------------------------------------------------------------------------------------------------

    @staticmethod
    def from_df(df: DataFrame, order_by: list[str], value: Column | str, rate: float | None = None) -> Stream:
        """A table in an order that is total."""
        value = F.col(value) if isinstance(value, str) else value

        def make(c: Context) -> DataFrame:
            found = indexing.dense_index(df.select(*order_by, value.alias("value")), order_by).select("idx", "value")
            return found if c.bound is None else found.where(F.col("idx") < c.bound)

        return Stream(make, rate)

    @staticmethod
    def from_indexed(df: DataFrame, rate: float | None = None, measure: int = 1, kind: str = "sample") -> Stream:
        """A table that has idx and value."""
        return Stream(lambda c: df if c.bound is None else df.where(F.col("idx") < c.bound), rate, measure=measure, kind=kind)

    @staticmethod
    def from_list(spark: SparkSession, values: list[Any], kind: str = "double") -> Stream:
        """A list held by the caller."""
        if not values:
            raise ValueError("a list source needs elements")
        return Stream.from_indexed(spark.createDataFrame(list(enumerate(values)), f"idx bigint, value {kind}"))

    @staticmethod
    def generate(fn: Callable[[Column, float], Column], rate: float | None = None, ends_at_null: bool = False) -> Stream:
        """fn(position, rate) from 0 on, without end, or up to the first null, which is looked for in stretches of growing length."""

        def make(c: Context) -> DataFrame:
            made = lambda lo, hi: c.spark.range(lo, hi).select(F.col("id").alias("idx"), fn(F.col("id"), rate_of(c.rate)).alias("value"))
            if ends_at_null:
                return made(0, first_null(made, c.bound))
            if c.bound is None:
                raise ValueError("an endless stream: trim it")
            return made(0, c.bound)

        return Stream(make, rate, finite=ends_at_null)

    @staticmethod
    def sine(hz: float, amplitude: float = 1.0, time_offset: float = 0.0, time: float | None = None) -> Stream:
        """amplitude cos(2 pi hz x) with x = time_offset + position / rate, and 0 after `time` seconds."""

        def fn(i: Column, rate: float) -> Column:
            x = F.lit(time_offset) + i / F.lit(rate)
            wave = F.lit(amplitude) * F.cos(x * F.lit(2.0 * math.pi * hz))
            return wave if time is None else F.when(x < time_offset + time, wave).otherwise(F.lit(0.0))

        return Stream.generate(fn)

    @staticmethod
    def sine_sweep(start: float, end: float, amplitude: float, time: float, time_offset: float = 0.0, delta: float = 0.1, exact: bool = False) -> Stream:
        """A wave whose frequency rises by delta at regular times; exact: so that it reaches `end` after `time` seconds. By default
        the steps come every time / (end - start) / delta seconds and the end is hardly approached."""

        def fn(i: Column, rate: float) -> Column:
            x = F.lit(time_offset) + i / F.lit(rate)
            if exact:
                steps = F.floor(F.least(x - time_offset, F.lit(time)) / (time * delta / (end - start)))
            else:
                steps = sweep_steps(i, rate, start, end, time, time_offset, delta)
            return F.lit(amplitude) * F.cos(x * F.lit(2.0 * math.pi) * (F.lit(float(start)) + F.lit(delta) * steps))

        return Stream.generate(fn)

    # -- plumbing ------------------------------------------------------------------------------------------------

    def build(self, spark: SparkSession, rate: float = 44100.0, bound: int | None = None) -> DataFrame:
        """The DataFrame of idx and value."""
        return self.make(Context(spark, self.rate or rate, bound))

    def check_rate(self, rate: float) -> None:
        """A sink writes at its rate only; it never resamples."""
        if self.rate is not None and rate_of(self.rate) != rate_of(rate):
            raise ValueError(f"this sink takes {rate} Hz, but the stream has {self.rate} Hz; nothing changes rates here, so add resample(to={rate})")

    def collect(self, spark: SparkSession, rate: float = 44100.0, bound: int | None = None) -> Iterator[Any]:
        """Values in order, one partition at a time."""
        self.check_rate(rate)
        return (r["value"] for r in self.build(spark, rate, bound).orderBy("idx").toLocalIterator())

    def _unary(self, fn: Callable[[DataFrame, Context], DataFrame], need: Callable[[int], int] | None = None, **changes: Any) -> Stream:
        def make(c: Context) -> DataFrame:
            return fn(self.make(c.need(None if c.bound is None or need is None else need(c.bound))), c)

        given = {"rate": self.rate, "finite": self.finite, "measure": self.measure, "kind": self.kind, "grid": self.grid} | changes
        return Stream(make, **given)

    def _binary(self, other: Stream, fn: Callable[[DataFrame, DataFrame, Context], DataFrame], **changes: Any) -> Stream:
        rates = {rate_of(r) for r in (self.rate, other.rate) if r is not None}
        if len(rates) > 1:
            raise ValueError(f"streams of different rates: {sorted(rates)}")
        given = {"rate": self.rate or other.rate, "finite": self.finite and other.finite, "measure": self.measure, "kind": self.kind, "grid": self.grid} | changes
        return Stream(lambda c: fn(self.make(c), other.make(c), c), **given)

    # -- element-wise --------------------------------------------------------------------------------------------

    def map(self, fn: Callable[[Column], Column], kind: str | None = None) -> Stream:
        """fn over each value."""
        return self._unary(lambda d, c: d.withColumn("value", fn(F.col("value"))), need=lambda n: n, kind=kind or self.kind)

    def map_batches(self, fn: Callable[[Any], Any], kind: str = "double", of: str | None = None) -> Stream:
        """A function in Python: from Arrow arrays of values to arrays of as many values of a type, as "double"."""
        return self._unary(lambda d, c: sequences.map_values(d, fn, kind), need=lambda n: n, kind=of or self.kind)

    def flat_map_batches(self, fn: Callable[[Any], Any], kind: str = "double", of: str = "sample") -> Stream:
        """A function in Python: from Arrow arrays of values to a list for each; their elements, of a type, at dense positions."""

        def make(d: DataFrame, c: Context) -> DataFrame:
            out = sequences.flat_values(d, fn, kind)
            return out if c.bound is None else out.where(F.col("idx") < c.bound)

        return self._unary(make, measure=1, kind=of, grid=None)

    def sequence(self, fn: Callable[[Any, slice, int], Any], before: int = 0, after: int = 0, rate: float | None = None, block: int = sequences.BLOCK) -> Stream:
        """A function in Python over stretches of samples, which sees so many samples before and after (see sequences.reaching()). rate: that of
        its outputs, if another."""

        def make(d: DataFrame, c: Context) -> DataFrame:
            out = sequences.reaching(d, fn, before, after, block)
            return out if c.bound is None else out.where(F.col("idx") < c.bound)

        return self._unary(make, rate=rate or self.rate)

    def scan(self, fn: Callable[[Any, Any], Any], state: Any, summary: Callable[[Any], Any], follow: Callable[[Any, Any], Any], block: int = sequences.BLOCK) -> Stream:
        """A function in Python with memory, over the samples from the first on (see sequences.scan())."""
        return self._unary(lambda d, c: sequences.scan(d, fn, state, summary, follow, block), need=lambda n: n)

    def _scalar(self, k: float, op: str) -> Stream:
        if self.kind == "window":
            return self._unary(lambda d, c: windows.map_elements(d, lambda x: {"+": x + k, "-": x - k, "*": x * k, "/": samples.divide(x, F.lit(float(k)))}[op]), need=lambda n: n)
        if self.kind == "vector":
            return self.map(lambda v: samples.vector_scalar(v, k, op))
        return self.map(lambda v: {"+": v + k, "-": v - k, "*": v * F.lit(float(k)), "/": v * F.lit(1.0 / k)}[op])

    def _merged(self, other: Stream | float, op: str) -> Stream:
        if not isinstance(other, Stream):
            return self._scalar(other, op)
        if self.kind == "window":
            return self._binary(other, lambda a, b, c: windows.merge_windows(a, b, lambda x, y: samples.combine(x, y, op)))
        if self.kind == "vector":
            return self.merge(other, lambda x, y: samples.vector_combine(x, y, op), kind="vector")
        return self.merge(other, lambda x, y: samples.combine(x, y, op))

    def __add__(self, other: Stream | float) -> Stream:
        return self._merged(other, "+")

    def __sub__(self, other: Stream | float) -> Stream:
        return self._merged(other, "-")

    def __mul__(self, other: Stream | float) -> Stream:
        return self._merged(other, "*")

    def __truediv__(self, other: Stream | float) -> Stream:
        return self._merged(other, "/")

    def change_amplitude(self, k: float) -> Stream:
        return self * k

    def taper(self, weight: str | Callable[[Column, Column], Column]) -> Stream:
        """A window function over windows: a name of functions.tapers.TAPERS, or weight(i, n)."""
        return self._unary(lambda d, c: windows.taper(d, tapers.TAPERS[weight] if isinstance(weight, str) else weight), need=lambda n: n)

    # -- parts and wholes ----------------------------------------------------------------------------------------

    def filter(self, keep: Callable[[Column], Column]) -> Stream:
        """Elements that keep() holds for, at new dense positions."""
        return self._unary(lambda d, c: indexing.dense_index(d.where(keep(F.col("value"))), ["idx"], "_at").select(F.col("_at").alias("idx"), "value"))

    def trim(self, length: int | TimeMeasure, unit: str = "ms") -> Stream:
        """The first elements, until they cover the length; the last one may go beyond it."""
        ns, m = _ns(length, unit), self.measure

        def make(c: Context) -> DataFrame:
            n = -(-index_floor(ns, c.rate) // m)
            return self.make(c.need(_both(c.bound, n))).where(F.col("idx") < n)

        return Stream(make, self.rate, True, self.measure, self.kind, self.grid)

    def range_projection(self, start: int | TimeMeasure, end: int | TimeMeasure | None = None, unit: str = "ms") -> Stream:
        """What lies from start to end, at positions from 0. Whole elements are skipped; what they go beyond start is not read."""
        m = self.measure

        def make(c: Context) -> DataFrame:
            first = max(0, index_floor(_ns(start, unit), c.rate))
            skip = -(-first // m)
            left = None if end is None else -(-(index_ceil(_ns(end, unit), c.rate) - first - (skip * m - first)) // m)
            n = _both(c.bound, left)
            df = self.make(c.need(None if n is None else skip + max(0, n))).where(F.col("idx") >= skip)
            df = df if left is None else df.where(F.col("idx") < skip + left)
            return df.withColumn("idx", F.col("idx") - skip)

        return Stream(make, self.rate, self.finite or end is not None, self.measure, self.kind, self.grid)

    def after_filling(self, value: float) -> Stream:
        """The stream, and the value without end after it."""

        def make(c: Context) -> DataFrame:
            if c.bound is None:
                raise ValueError("an endless stream: trim it")
            df = self.make(c).select("idx", F.struct("value").alias("_v"))
            return c.spark.range(c.bound).withColumnRenamed("id", "idx").join(df, "idx", "left").select("idx", F.when(F.col("_v").isNull(), F.lit(value)).otherwise(F.col("_v.value")).alias("value"))

        return Stream(make, self.rate, False, self.measure, self.kind)

    def concat(self, other: Stream) -> Stream:
        """This finite stream, then the other."""
        if not self.finite:
            raise ValueError("nothing comes after an endless stream")

        def make(c: Context) -> DataFrame:
            left = self.make(c)
            n = left.count()
            if c.bound is not None and n >= c.bound:
                return left
            right = other.make(c.need(None if c.bound is None else c.bound - n))
            return left.unionByName(right.withColumn("idx", F.col("idx") + F.lit(n)))

        return Stream(make, self.rate or other.rate, other.finite, self.measure, self.kind, self.grid if self.grid == other.grid else None)

    def merge(self, other: Stream, fn: Callable[[Column, Column], Column], ends_at_null: bool = False, kind: str | None = None) -> Stream:
        """fn over the values at each position, null where a stream has ended; ends_at_null: the first null of fn ends the stream."""

        def both(a: DataFrame, b: DataFrame, c: Context) -> DataFrame:
            left, right = a.select("idx", F.col("value").alias("_a")), b.select("idx", F.col("value").alias("_b"))
            df = left.join(right, "idx", "full_outer").select("idx", fn(F.col("_a"), F.col("_b")).alias("value"))
            return cut_at_null(df) if ends_at_null else df

        return self._binary(other, both, kind=kind or self.kind)

    # -- windows -------------------------------------------------------------------------------------------------

    def window(self, size: int, step: int | None = None) -> Stream:
        """Windows of size elements every step elements; the last ones may be shorter."""
        step = size if step is None else step
        return self._unary(lambda d, c: windows.window(d, size, step), need=lambda n: (n - 1) * step + size, measure=step * self.measure, kind="window", grid=(size, step))

    def window_agg(self, size: int, step: int | None = None, **aggregates: Column) -> Stream:
        """Aggregates over each window's idx and value columns, as a struct value."""
        step = size if step is None else step

        def make(d: DataFrame, c: Context) -> DataFrame:
            found = windows.window_agg(d, size, step, **aggregates)
            return found.select("idx", F.struct(*aggregates).alias("value"))

        return self._unary(make, need=lambda n: (n - 1) * step + size, measure=step * self.measure, kind="struct", grid=(size, step))

    def window_fold(self, size: int, step: int | None = None, how: str = "sum") -> Stream:
        """A "sum", "count", "min" or "max" of each window, at a cost that does not grow with size / step."""
        step = size if step is None else step
        return self._unary(lambda d, c: windows.fold(d, size, step, how), need=lambda n: (n - 1) * step + size, measure=step * self.measure, kind="sample", grid=None)

    def flatten(self, resolve: Callable[[Column, Column], Column] | None = None, zero: float = 0.0) -> Stream:
        """Windows, vectors or lists as single elements. Windows overlap by addition or by resolve(following, current)."""
        if self.kind == "window":
            size, step = self.grid or (1, 1)
            return self._unary(lambda d, c: windows.flatten_windows(d, F.lit(zero), resolve, self.grid and step), need=lambda n: -(-n // step), measure=1, kind="sample", grid=None)
        return self.flat_map(lambda v: v)

    def flat_map(self, fn: Callable[[Column], Column], kind: str = "sample") -> Stream:
        """The elements of the arrays that fn makes, at dense positions."""

        def make(d: DataFrame, c: Context) -> DataFrame:
            out = d.select("idx", F.posexplode(fn(F.col("value"))).alias("_i", "value"))
            out = indexing.dense_index(out, ["idx", "_i"], "_at").select(F.col("_at").alias("idx"), "value")
            return out if c.bound is None else out.where(F.col("idx") < c.bound)

        return self._unary(make, measure=1, kind=kind, grid=None)

    def vectors(self, size: int) -> Stream:
        """Samples in arrays of size."""
        return self.window(size).map(lambda w: w["elements"], kind="vector")

    # -- rates and spectra ---------------------------------------------------------------------------------------

    def resample(self, to: float | None = None, reduce: Callable[[Column], Column] | None = None, method: str = "sinc", taps: int = 32, align: bool = False) -> Stream:
        """Another rate. method: "sinc", "simple" (with reduce for a lower rate), or a function (df, from, to) -> df."""

        def make(c: Context) -> DataFrame:
            source, target = self.rate or c.rate, to or c.rate
            if rate_of(source) == rate_of(target):
                return self.make(c)
            inner = Context(c.spark, source, None if c.bound is None else math.ceil(c.bound * source / target) + taps)
            df = self.make(inner)
            if callable(method):
                return method(df, source, target)
            found = resample.simple(df, source, target, reduce) if method == "simple" else resample.sinc(df, source, target, taps, align=align)
            return found if c.bound is None else found.where(F.col("idx") < c.bound)

        return Stream(make, to, self.finite, self.measure, self.kind, self.grid)

    def fft(self, bins: int, sign: str = "reference") -> Stream:
        return self._unary(lambda d, c: spectral.fft(d, bins, c.rate, sign), need=lambda n: n, kind="fft")

    def inverse_fft(self, sign: str = "reference") -> Stream:
        return self._unary(lambda d, c: spectral.inverse_fft(d, sign), need=lambda n: n, kind="window")

    def dft(self, inverse: bool = False) -> Stream:
        """Transforms of windows at their own length, whatever it is, as arrays of struct(re, im); inverse: of such arrays."""
        return self._unary(lambda d, c: spectral.dft(d, inverse), need=lambda n: n, kind="complex")


#: Positions that a generator is looked over for its end, at first and at most.
PROBE, MOST = 1 << 16, 1 << 40


def first_null(made: Callable[[int, int], DataFrame], bound: int | None) -> int:
    """The position of the first null of made(from, to), or the bound: stretches are twice as long as all before them, so that the work is
    at most three times that of the stream."""
    low, high = 0, PROBE
    while bound is None or low < bound:
        if low >= MOST:
            raise ValueError(f"no end within {MOST} elements: trim the stream")
        high = high if bound is None else min(high, bound)
        found = made(low, high).where(F.col("value").isNull()).agg(F.min("idx")).first()[0]
        if found is not None:
            return found
        low, high = high, 3 * high
    return bound


def cut_at_null(df: DataFrame) -> DataFrame:
    """What comes before the first null value."""
    first = df.where(F.col("value").isNull()).agg(F.min("idx").alias("end"))
    return df.where(F.col("idx") < F.coalesce(first.scalar(), F.lit((1 << 63) - 1)))


def sweep_steps(i: Column, rate: float, start: float, end: float, time: float, time_offset: float, delta: float) -> Column:
    """How often the frequency of a sweep has risen before sample i: the first time at the first sample that is less than one
    sample from a whole interval, then with that period plus the sample that a rise takes, and not after `time`."""
    interval = time / (end - start) / delta
    first = max(0, math.floor(interval * rate - 1) + 1)
    period, last = first + 1, math.ceil(time * rate) - 1
    return F.floor((F.least(i, F.lit(last)) + (period - 1 - first)) / F.lit(float(period)))
