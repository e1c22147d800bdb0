"""Changing the rate of a stream."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions.time import rate_of

#: Outputs that one task group of the sinc filter makes.
BLOCK = 1 << 15


def simple(df: DataFrame, source: float, target: float, reduce: Callable[[Column], Column] | None = None) -> DataFrame:
    """Repeat samples (target a multiple of source) or reduce chunks of them (source a multiple of target). reduce takes a
    column and is an aggregate, as F.sum."""
    source, target = rate_of(source), rate_of(target)
    if target >= source:
        k = target / source
        if k != int(k):
            raise ValueError(f"{source} Hz to {target} Hz is no whole factor")
        if k == 1:
            return df
        return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(int(k) - 1))).alias("_i")).select((F.col("idx") * int(k) + F.col("_i")).alias("idx"), "value")
    k = source / target
    if k != int(k):
        raise ValueError(f"{source} Hz to {target} Hz is no whole factor")
    if reduce is None:
        raise ValueError("a lower rate needs a function to reduce samples")
    return df.groupBy(F.expr(f"idx div {int(k)}").alias("idx")).agg(reduce(F.col("value")).alias("value"))


def _starts(k: np.ndarray, source: float, target: float) -> tuple[np.ndarray, np.ndarray]:
    """First tap and phase of outputs k; both truncations are part of the definition."""
    t = k / target
    s = np.trunc(np.trunc(t * source) / source * source)
    return s.astype(np.int64), t * source - s


def sinc_length(n: int, source: float, target: float, taps: int) -> int:
    """Number of outputs for n inputs: up to the first output whose tap moved on while the one before already met the end."""
    source, target = rate_of(source), rate_of(target)
    at = max(0, int((n - taps) * target / source) - 4)
    while True:
        k = np.arange(max(at - 1, 0), at + 4096)
        s, _ = _starts(k.astype(np.float64), source, target)
        ends = np.flatnonzero((s[1:] > s[:-1]) & (s[:-1] + taps >= n))
        if len(ends):
            return int(k[ends[0] + 1])
        at += 4096


def sinc(df: DataFrame, source: float, target: float, taps: int = 32, n: int | None = None, align: bool = False) -> DataFrame:
    """Windowed-sinc interpolation: y[k] = sum over i < taps of x[s + i] sinc(i - taps / 2 - p). Outputs are ahead of inputs by
    taps / 2 samples; align=True centres them. Blocks of outputs get their inputs with a halo and are filtered with numpy."""
    source, target = rate_of(source), rate_of(target)
    n = df.count() if n is None else n
    total, shift = sinc_length(n, source, target, taps), taps // 2 if align else 0
    ratio = target / source
    j = F.col("idx") + shift
    low = F.greatest(F.floor(((j - taps - 1) * ratio - 1) / BLOCK), F.lit(0))
    high = F.least(F.floor(((j + 1) * ratio + 1) / BLOCK), F.lit(max(0, (total - 1) // BLOCK)))
    dealt = df.where(low <= high).select(j.alias("j"), F.col("value").cast("double").alias("x"), F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("block"))

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        k = np.arange(block * BLOCK, min((block + 1) * BLOCK, total))
        if not len(k):
            return pa.table({"idx": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        s, p = _starts(k.astype(np.float64), source, target)
        x = np.zeros(int(s[-1]) + taps - int(s[0]) + 1)
        at, values = table.column("j").to_numpy() - int(s[0]), table.column("x").to_numpy()
        inside = (at >= 0) & (at < len(x))
        x[at[inside]] = values[inside]
        y = np.zeros(len(k))
        for i in range(taps):
            y += x[s - s[0] + i] * np.sinc(i - taps / 2 - p)
        return pa.table({"idx": k, "value": y})

    return dealt.groupBy("block").applyInArrow(run, "idx long, value double")
