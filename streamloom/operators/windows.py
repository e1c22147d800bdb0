"""Windows over positions, and putting them together again. Frames have idx and value; a window is
struct(size, step, elements), the last ones may be partial."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.operators import indexing, sequences


def window_ids(idx: Column, size: int, step: int) -> Column:
    """The windows that hold a position."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((idx - (size - 1)) / F.lit(float(step))).cast("long"))
    return F.sequence(first, F.floor(idx / F.lit(float(step))).cast("long"))


def members(df: DataFrame, size: int, step: int) -> DataFrame:
    """(wid, idx, value) for each window and element; what lies in gaps is dropped first."""
    kept = df.where(F.col("idx") % step < size) if step > size else df
    if size == step:
        return kept.select(F.expr(f"idx div {step}").alias("wid"), "idx", "value")
    return kept.select(F.explode(window_ids(F.col("idx"), size, step)).alias("wid"), "idx", "value")


def window(df: DataFrame, size: int, step: int) -> DataFrame:
    """idx and value struct(size, step, elements) of every window that starts within the stream."""
    if size < 2 or step < 1:
        raise ValueError("a window needs size > 1 and step >= 1")
    listed = members(df, size, step).groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("e"))
    return listed.select(F.col("wid").alias("idx"), F.struct(F.lit(size).alias("size"), F.lit(step).alias("step"), F.transform("e", lambda x: x["value"]).alias("elements")).alias("value"))


def window_agg(df: DataFrame, size: int, step: int, **aggregates: Column) -> DataFrame:
    """Aggregates of each window with partial aggregation before the shuffle; no element lists."""
    return members(df, size, step).groupBy(F.col("wid").alias("idx")).agg(*(a.alias(k) for k, a in aggregates.items()))


#: What a window is folded by: the aggregate of a pane, what panes are put together with, and a pane without values.
FOLDS = {"sum": (F.sum, np.add, 0.0), "count": (F.count, np.add, 0.0), "min": (F.min, np.fmin, np.nan), "max": (F.max, np.fmax, np.nan)}


def fold(df: DataFrame, size: int, step: int, how: str, block: int = sequences.BLOCK) -> DataFrame:
    """idx and value (a double): "sum", "count", "min" or "max" over every window that starts within the stream; nulls are skipped, and extremes
    of none are null.

    Elements are folded into panes of gcd(size, step), which is a partial aggregate. Windows are whole panes; with panes in stretches of a
    window's length, each window is the end of one stretch and the beginning of the next: two scans, however small the step is."""
    aggregate, join, none = FOLDS[how]
    pane = math.gcd(size, step)
    wide, stride = size // pane, step // pane
    panes = df.groupBy(F.expr(f"idx div {pane}").alias("idx")).agg(aggregate("value").cast("double").alias("value"))

    def run(x: np.ndarray, here: slice, start: int) -> np.ndarray:
        n = -(-(len(x) + wide) // wide) * wide
        filled = np.full(n + wide, none)
        filled[: len(x)] = np.where(np.isnan(x), none, x)
        rows = filled.reshape(-1, wide)
        prefix = join.accumulate(rows, axis=1).ravel()
        suffix = join.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = np.arange(here.start, here.stop)
        found = join(suffix[at], prefix[at + wide - 1]) if wide > 1 else filled[at]
        # A window that is a stretch of its own is counted once.
        found = np.where(at % wide == 0, suffix[at], found)
        return found[(start + at - here.start) % stride == 0]

    out = sequences.reaching(panes, run, after=wide - 1, block=max(1, block // stride) * stride)
    return out.select("idx", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def map_elements(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """fn over every element of every window; partial windows stay partial."""
    v = F.col("value")
    return df.withColumn("value", F.struct(v["size"].alias("size"), v["step"].alias("step"), F.transform(v["elements"], fn).alias("elements")))


def taper(df: DataFrame, weight: Callable[[Column, Column], Column]) -> DataFrame:
    """Multiply element i by weight(i, number of elements)."""
    v = F.col("value")
    shaped = F.transform(v["elements"], lambda x, i: x * weight(i, F.size(v["elements"])))
    return df.withColumn("value", F.struct(v["size"].alias("size"), v["step"].alias("step"), shaped.alias("elements")))


def padded(elements: Column, size: Column | int, zero: Column) -> Column:
    """elements, filled up to size."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(elements, F.array_repeat(zero, F.greatest(size - F.size(elements), F.lit(0))))


def flatten_windows(df: DataFrame, zero: Column | None = None, resolve: Callable[[Column, Column], Column] | None = None, step: int | None = None) -> DataFrame:
    """Elements at their positions again. Windows are padded to their size and gaps filled with zero; overlapping elements are
    added, or folded by resolve(following, current) from the first window on. Of more than two at a position all are folded.
    Windows are placed one after the other by the steps of those before them; step: all have this one, and positions are a product."""
    zero = F.lit(0.0) if zero is None else zero
    v = F.col("value")
    if step is not None:
        placed, start = df, F.col("idx") * step
    else:
        placed, start = indexing.running_sum(df, v["step"].cast("long"), "start"), F.col("start")
    cells = placed.select("idx", start.cast("long").alias("start"), F.posexplode(padded(v["elements"], F.greatest(v["size"], v["step"]), zero)).alias("i", "x"))
    at = cells.select((F.col("start") + F.col("i")).alias("pos"), F.col("idx").alias("wid"), "x")
    if resolve is None:
        return at.groupBy(F.col("pos").alias("idx")).agg(F.sum("x").alias("value"))
    listed = at.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("wid", "x"))).alias("e"))
    rest = F.slice("e", F.lit(2), F.greatest(F.size("e") - 1, F.lit(0)))
    return listed.select(F.col("pos").alias("idx"), F.aggregate(rest, F.get("e", F.lit(0))["x"], lambda current, following: resolve(following["x"], current)).alias("value"))


def merge_windows(left: DataFrame, right: DataFrame, fn: Callable[[Column, Column], Column], zero: float = 0.0) -> DataFrame:
    """fn over the elements of windows at the same position, both padded to their size; a missing window is all zeros.
    Sizes and steps must be equal."""
    a = left.select("idx", F.col("value").alias("a"))
    b = right.select("idx", F.col("value").alias("b"))
    size, step = F.coalesce(F.col("a")["size"], F.col("b")["size"]), F.coalesce(F.col("a")["step"], F.col("b")["step"])
    differ = F.coalesce((F.col("a")["size"] != F.col("b")["size"]) | (F.col("a")["step"] != F.col("b")["step"]), F.lit(False))
    checked = F.when(differ, F.raise_error(F.lit("windows differ in size or step")).cast("int")).otherwise(size)
    empty = F.array().cast("array<double>")
    fill = lambda x: padded(F.coalesce(x["elements"], empty), size, F.lit(zero))
    return a.join(b, "idx", "full_outer").select("idx", F.struct(checked.alias("size"), step.alias("step"), F.zip_with(fill(F.col("a")), fill(F.col("b")), fn).alias("elements")).alias("value"))
