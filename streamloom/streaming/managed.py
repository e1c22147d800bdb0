"""Streams with control signals in band: which file each element goes to.

The machine has a small state. Over a whole table its parts are carried along by windows or range by range (files()); advance() goes on
from a state and tells the next one, for streams that come in batches; step() is the same for the rows of one key in a task."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators import indexing
from streamloom.scratch import materialize

# The signals.
NOOP, FLUSH, OPEN_GATE, CLOSE_GATE, CLOSE_OUTPUT = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class State:
    """What a stream has come to: whether its gate is open, its output closed, anything written; its file's number and argument."""

    open: bool = True
    ended: bool = False
    some: bool = False
    file_no: int = 0
    argument: Any = None


def step(signal: np.ndarray, argument: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, State]:
    """Elements of one stream in order: which are written, which of those begin a file, their file's number and its argument; the
    state after them. The rules are those of files()."""
    n = len(signal)
    turns = np.where(np.isin(signal, (OPEN_GATE, CLOSE_GATE)), np.arange(n), -1)
    at = np.maximum.accumulate(turns) if n else turns
    is_open = np.where(at >= 0, signal[np.maximum(at, 0)] == OPEN_GATE, state.open)
    was_open = np.concatenate([[state.open], is_open[:-1]])[:n]
    closes = np.cumsum(signal == CLOSE_OUTPUT)
    written = is_open & ~(state.ended | (closes - (signal == CLOSE_OUTPUT) > 0))
    count = np.cumsum(written)
    some = state.some | (count - written > 0)
    starts = written & (((signal == FLUSH) & some) | ((signal == OPEN_GATE) & ~was_open))
    file_no = state.file_no + np.cumsum(starts)
    last = np.maximum.accumulate(np.where(starts, np.arange(n), -1)) if n else turns
    arguments = np.array([state.argument, *argument], object)[last + 1]
    if n:
        state = State(bool(is_open[-1]), bool(state.ended | (closes[-1] > 0)), bool(state.some | (count[-1] > 0)), int(file_no[-1]), arguments[-1])
    return written, written & (starts | ~some), file_no, arguments, state


def files(df: DataFrame, signal: Column, argument: Column, keys: list[str] | None = None) -> DataFrame:
    """The rows that are written, with file_no and suffix_argument; df has idx.

    A flush ends the file before its element; the element of a closing gate is not written, that of an opening gate is;
    the element of a closing output is written, if the gate is open, and is the last. Repeated opening or closing
    changes nothing. A new file starts at a flush after something was written, and at an opening gate; its argument names
    it, the first file has none. keys: one stream for each key, in windows, but for keys of more than HOT rows, whose state is carried over
    ranges. Without keys the state runs over the whole stream,
    range by range: each is summed up and goes on from what those before it come to.
    """
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_hot_{k}"))
        hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(*(F.col(f"`{k}`").alias(f"_hot_{k}") for k in keys))
        hot = materialize(hot, "hot-keys")
        if not hot.isEmpty():
            cold, _ = _marked(df.join(hot, same, "left_anti"), signal, argument, keys, State(), ranges=False)
            warm, dropped = _marked(df.join(hot, same, "left_semi"), signal, argument, keys, State(), ranges=True)
            return cold.where("_written = 1").drop(*_PARTS).unionByName(warm.where("_written = 1").drop(*_PARTS, *dropped))
    s, dropped = _marked(df, signal, argument, keys, State(), ranges=not keys)
    return s.where("_written = 1").drop(*_PARTS, *dropped)


def advance(df: DataFrame, signal: Column, argument: Column, state: State) -> tuple[DataFrame, State]:
    """files() of the next elements of a stream without keys that has come to a state, with `begins` on the first row of each file; and the
    state after them. df has idx."""
    marked, dropped = _marked(df, signal, argument, None, state, ranges=True)
    s = materialize(marked.withColumn("begins", (F.coalesce("_starts", F.lit(0)) == 1) | (F.col("_some") == 0)), "marked")
    known = F.when(F.col("_gate").isNotNull(), F.col("idx"))
    found = s.agg(
        F.max_by("_gate", known).alias("gate"), F.max((F.col("_s") == CLOSE_OUTPUT).cast("int")).alias("ended"), F.max("_written").alias("some"),
        F.max("file_no").alias("file_no"), F.max_by("_arg", F.when(F.col("_starts") == 1, F.col("idx"))).alias("argument"), F.max("_starts").alias("starts"), F.count("*").alias("n"),
    ).first()
    if found["n"]:
        state = State(state.open if found["gate"] is None else bool(found["gate"]), state.ended or bool(found["ended"]), state.some or bool(found["some"]), found["file_no"], found["argument"] if found["starts"] else state.argument)
    return s.where("_written = 1").drop(*_PARTS, *dropped), state


#: Columns of the machine that _marked() adds.
_PARTS = ["_s", "_arg", "_gate", "_was", "_open", "_ended", "_written", "_some", "_starts"]


#: Rows of one key that a task takes at most.
HOT = 1 << 22


def _marked(df: DataFrame, signal: Column, argument: Column, keys: list[str] | None, state: State, ranges: bool) -> tuple[DataFrame, list[str]]:
    """All rows with the parts of the machine, by ranges or by windows over keys, and the names of further columns."""
    s = df.withColumn("_s", signal).withColumn("_arg", argument)
    if not ranges:
        every = Window.partitionBy(*keys).orderBy("idx")
        over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}

        def scan(rows: DataFrame, column: Column, name: str, how: str, inclusive: bool = False) -> DataFrame:
            return rows.withColumn(name, over[how](column).over(every.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))

        dropped = []
    else:
        s, part, place = indexing.ranged(s, [*(keys or []), "idx"])

        def scan(rows: DataFrame, column: Column, name: str, how: str, inclusive: bool = False) -> DataFrame:
            return indexing.carry(rows, part, place, column, name, how, inclusive, keys)

        dropped = [part, place]
    s = s.withColumn("_gate", F.when(F.col("_s").isin(OPEN_GATE, CLOSE_GATE), (F.col("_s") == OPEN_GATE).cast("int")))
    s = scan(scan(s, F.col("_gate"), "_was", "last"), F.col("_gate"), "_open", "last", True)
    s = scan(s, (F.col("_s") == CLOSE_OUTPUT).cast("int"), "_ended", "max")
    ended = F.lit(1) if state.ended else F.coalesce("_ended", F.lit(0))
    s = s.withColumn("_written", (F.coalesce("_open", F.lit(int(state.open))) * (1 - ended)))
    s = scan(s, F.col("_written"), "_some", "max")
    some = F.lit(1) if state.some else F.coalesce("_some", F.lit(0))
    starts = (F.col("_written") == 1) & (((F.col("_s") == FLUSH) & (some == 1)) | ((F.col("_s") == OPEN_GATE) & (F.coalesce("_was", F.lit(int(state.open))) == 0)))
    s = s.withColumn("_some", some).withColumn("_starts", starts.cast("long"))
    s = scan(s, F.col("_starts"), "file_no", "sum", True)
    # In a struct, so that a null argument is one.
    s = scan(s, F.when(F.col("_starts") == 1, F.struct(F.col("_arg").alias("of"))), "suffix_argument", "last", True).withColumn("suffix_argument", F.col("suffix_argument.of"))
    if state.file_no:
        s = s.withColumn("file_no", F.col("file_no") + state.file_no)
    if state.argument is not None:
        # The file that went on from before keeps its argument; a later one has its own, null or not.
        kept = F.lit(state.argument).cast(s.schema["suffix_argument"].dataType)
        s = s.withColumn("suffix_argument", F.when(F.col("file_no") == state.file_no, kept).otherwise(F.col("suffix_argument")))
    return s, dropped
