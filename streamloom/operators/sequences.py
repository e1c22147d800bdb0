"""Functions in Python over streams: over elements in Arrow batches, and over stretches of a sequence.

A function over a sequence runs block by block, each block in a task. What it needs of the blocks beside is declared: a reach of so
many elements before and after, or a state. States of any function would make blocks wait for each other; so it tells besides what a
block does to a state, in two passes: all blocks are summed up, the driver goes over the summaries, one for each block, and all
blocks run from the states that they begin with.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from streamloom.operators import indexing

#: Elements of one block.
BLOCK = 1 << 18


def _arrow(kind: str) -> pa.DataType:
    return to_arrow_type(DataType.fromDDL(kind))


def _array(found: Any, kind: pa.DataType) -> pa.Array:
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return found.cast(kind) if isinstance(found, pa.Array) else pa.array(found, kind)


def map_values(df: DataFrame, fn: Callable[[pa.Array], Any], kind: str) -> DataFrame:
    """fn over the values of Arrow batches: an array, or what makes one, of as many values."""
    arrow = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _array(fn(b.column("value")), arrow)
            if len(found) != b.num_rows:
                raise ValueError(f"{len(found)} values for {b.num_rows}")
            yield pa.RecordBatch.from_arrays([b.column("idx"), found], names=["idx", "value"])

    return df.select("idx", "value").mapInArrow(run, f"idx bigint, value {kind}")


def flat_values(df: DataFrame, fn: Callable[[pa.Array], Any], kind: str) -> DataFrame:
    """fn gives a list for each value of Arrow batches; their elements at dense positions."""
    arrow = pa.list_(_arrow(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = _array(fn(b.column("value")), arrow)
            if len(lists) != b.num_rows:
                raise ValueError(f"{len(lists)} lists for {b.num_rows} values")
            of = pc.list_parent_indices(lists)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b.column("idx").take(of), pa.array(within, pa.int64()), lists.flatten()], names=["idx", "i", "value"])

    rows = df.select("idx", "value").mapInArrow(run, f"idx bigint, i bigint, value {kind}")
    return indexing.dense_index(rows, ["idx", "i"], "at").select(F.col("at").alias("idx"), "value")


def _blocks(df: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """Elements by block, with those that a block reaches."""
    if before == after == 0:
        return df.select(F.expr(f"idx div {block}").alias("block"), "idx", F.col("value").cast("double").alias("value"))
    low = F.greatest(F.floor((F.col("idx") - after) / F.lit(block)), F.lit(0)).cast("long")
    high = F.floor((F.col("idx") + before) / F.lit(block)).cast("long")
    return df.select(F.explode(F.sequence(low, high)).alias("block"), "idx", F.col("value").cast("double").alias("value"))


def _sorted(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    table = table.sort_by("idx")
    return table.column("block")[0].as_py(), table.column("idx").to_numpy(), table.column("value").to_numpy()


def reaching(df: DataFrame, fn: Callable[[np.ndarray, slice, int], Sequence[float]], before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """fn(x, here, start) for each block: x are its elements (null: NaN) with up to `before` and `after` others, x[here] its own, the first at
    position start. What it returns, of any length, stands in the place of x[here]."""

    def run(table: pa.Table) -> pa.Table:
        number, idx, x = _sorted(table)
        start = number * block
        lo, hi = np.searchsorted(idx, start), np.searchsorted(idx, start + block)
        # Elements of the next block may reach back where this one has none: the stream ended before.
        found = np.asarray(fn(x, slice(int(lo), int(hi)), start), np.float64) if lo < hi else np.zeros(0)
        return pa.table({"block": np.full(len(found), number), "i": np.arange(len(found)), "value": found})

    rows = _blocks(df, before, after, block).groupBy("block").applyInArrow(run, "block bigint, i bigint, value double")
    return indexing.dense_index(rows, ["block", "i"], "at").select(F.col("at").alias("idx"), "value")


def scan(df: DataFrame, fn: Callable[[np.ndarray, Any], tuple[Sequence[float], Any]], state: Any, summary: Callable[[np.ndarray], Any], follow: Callable[[Any, Any], Any], block: int = BLOCK) -> DataFrame:
    """fn(x, state) for each block, from the state that those before it come to: its outputs, as many as x, and the state after it.
    follow(state, summary(x)) has to be that state too; so the driver finds all states from one summary for each block."""

    def first(table: pa.Table) -> pa.Table:
        number, _, x = _sorted(table)
        return pa.table({"block": [number], "summary": pa.array([pickle.dumps(summary(x))], pa.binary())})

    dealt = _blocks(df, 0, 0, block)
    sums = sorted((r["block"], r["summary"]) for r in dealt.groupBy("block").applyInArrow(first, "block bigint, summary binary").collect())
    states = {}
    for number, found in sums:
        states[number] = state
        state = follow(state, pickle.loads(bytes(found)))
    shared = df.sparkSession.sparkContext.broadcast(states)

    def second(table: pa.Table) -> pa.Table:
        number, idx, x = _sorted(table)
        found = np.asarray(fn(x, shared.value[number])[0], np.float64)
        if len(found) != len(x):
            raise ValueError(f"{len(found)} values for {len(x)}")
        return pa.table({"idx": idx, "value": found})

    return dealt.groupBy("block").applyInArrow(second, "idx bigint, value double")
