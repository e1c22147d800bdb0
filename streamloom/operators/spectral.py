"""Fourier transforms of windows. A spectrum is struct(index, binCount, samplesCount, samplesLength, sampleRate, fft), with fft
an array of struct(re, im)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

SPECTRUM = "struct<index: bigint, binCount: int, samplesCount: int, samplesLength: int, sampleRate: float, fft: array<struct<re: double, im: double>>>"
_COMPLEX = pa.struct([("re", pa.float64()), ("im", pa.float64())])


def zero_pad(x: np.ndarray, n: int) -> np.ndarray:
    """x rotated about its middle, with zeros between the second part, which comes first, and the first."""
    m = len(x)
    if m == n:
        head = m - (m + 1) // 2
        return np.concatenate([x[head:], x[:head]]) if m else x
    head = m - (m + 1) // 2
    out = np.zeros(n, x.dtype)
    out[: m - head] = x[head:]
    if head:
        out[n - head :] = x[:head]
    return out


def undo_pad(x: np.ndarray, m: int) -> np.ndarray:
    return np.concatenate([x[len(x) - m // 2 :], x[: (m + 1) // 2]])


def fft(df: DataFrame, bins: int, rate: float, sign: str = "reference") -> DataFrame:
    """Spectra of windows of samples. sign: "reference" has exp(+2 pi i) in the forward transform, "standard" exp(-2 pi i)."""
    if bins < 1 or bins & (bins - 1):
        raise ValueError("the number of bins has to be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = b.column(0)
            lists = b.column(2)
            sizes = [len(x) if x is not None else 0 for x in (v.values for v in lists)]
            if max(sizes, default=0) > bins:
                raise ValueError("a window has more elements than bins")
            x = np.array([zero_pad(np.asarray(v.values.to_numpy(zero_copy_only=False) if s else [], np.float64), bins) for v, s in zip(lists, sizes, strict=True)]).reshape(-1, bins)
            f = np.fft.fft(x, axis=1)
            f = np.conj(f) if sign == "reference" else f
            parts = pa.StructArray.from_arrays([pa.array(f.real.ravel()), pa.array(f.imag.ravel())], fields=list(_COMPLEX))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * bins), parts)
            n = len(f)
            value = pa.StructArray.from_arrays(
                [index, pa.array(np.full(n, bins, np.int32)), pa.array(np.array(sizes, np.int32)), b.column(1), pa.array(np.full(n, rate, np.float32)), arrays],
                names=["index", "binCount", "samplesCount", "samplesLength", "sampleRate", "fft"],
            )
            yield pa.RecordBatch.from_arrays([index, value], names=["idx", "value"])

    v = F.col("value")
    return df.select("idx", v["step"].cast("int").alias("step"), F.transform(v["elements"], lambda x: x.cast("double")).alias("elements")).mapInArrow(run, f"idx bigint, value {SPECTRUM}")


def inverse_fft(df: DataFrame, sign: str = "reference") -> DataFrame:
    """Windows of the real parts; a window's size is its number of samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for z, m in zip(b.column(3), b.column(1).to_pylist(), strict=True):
                c = z.values.field("re").to_numpy() + 1j * z.values.field("im").to_numpy()
                x = np.fft.ifft(np.conj(c) if sign == "reference" else c)
                out.append(undo_pad(x.real, m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.float64()))], names=["idx", "size", "step", "elements"])

    v = F.col("value")
    flat = df.select("idx", v["samplesCount"].alias("size"), v["samplesLength"].alias("step"), v["fft"].alias("fft")).mapInArrow(run, "idx bigint, size int, step int, elements array<double>")
    return flat.select("idx", F.struct("size", "step", "elements").alias("value"))


def dft(df: DataFrame, inverse: bool = False) -> DataFrame:
    """Transforms of any length, with the textbook's sign: of windows, vectors or arrays of struct(re, im) to arrays of struct(re, im).
    Prime lengths take n log n steps as others do (chirp-z); arrays of a batch with the same length are transformed together."""
    kind = df.schema["value"].dataType
    v = F.col("value.elements") if isinstance(kind, StructType) else F.col("value")
    real = not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StructType)
    z = F.transform(v, lambda x: F.struct(x.cast("double").alias("re"), F.lit(0.0).alias("im"))) if real else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("value")
            flat = lists.flatten()
            c = flat.field("re").to_numpy() + 1j * flat.field("im").to_numpy()
            n = np.array([len(x) if x is not None else 0 for x in (e.values for e in lists)], np.int64)
            starts, out = np.cumsum(n) - n, np.empty(len(c), np.complex128)
            for size in np.unique(n[n > 0]):
                at = starts[n == size][:, None] + np.arange(size)
                out[at] = np.fft.ifft(c[at], axis=1) if inverse else np.fft.fft(c[at], axis=1)
            parts = pa.StructArray.from_arrays([pa.array(out.real), pa.array(out.imag)], fields=list(_COMPLEX))
            yield pa.RecordBatch.from_arrays([b.column("idx"), pa.ListArray.from_arrays(pa.array(np.append(starts, len(c)), pa.int32()), parts)], names=["idx", "value"])

    return df.select("idx", z.alias("value")).mapInArrow(run, "idx bigint, value array<struct<re: double, im: double>>")


def magnitude(value: Column) -> Column:
    """20 log10 |c| of the first half of the bins; -inf for 0."""
    n = F.floor(value["binCount"] / 2).cast("int")

    def one(c: Column) -> Column:
        size = F.sqrt(c["re"] * c["re"] + c["im"] * c["im"])
        return F.when(size == 0, F.lit(float("-inf"))).otherwise(F.lit(20.0) * F.log10(size))

    return F.transform(F.slice(value["fft"], F.lit(1), n), one)


def phase(value: Column) -> Column:
    """The angle of the first half of the bins."""
    return F.transform(F.slice(value["fft"], F.lit(1), F.floor(value["binCount"] / 2).cast("int")), lambda c: F.atan2(c["im"], c["re"]))


def frequency(value: Column) -> Column:
    """The frequency of each of the first half of the bins."""
    n = F.floor(value["binCount"] / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * value["sampleRate"].cast("double") / value["binCount"])


def bin_of(value: Column, hz: float) -> Column:
    """The bin that a frequency falls in."""
    return F.least(value["binCount"].cast("long"), F.rint(F.lit(float(hz)) / value["sampleRate"].cast("double") * value["binCount"]).cast("long"))


def time_ns(value: Column) -> Column:
    """When the window starts, in whole nanoseconds."""
    return (value["index"] * value["samplesLength"] / (value["sampleRate"].cast("double") / F.lit(1e9))).cast("long")
