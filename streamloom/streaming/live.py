"""Managed outputs of streams that are running: signals in band, files as they come.

Two kinds of streams. One for each key: the machine's state is kept by key in the state store of a streaming query, and a micro-batch
shuffles by key. A single one: each micro-batch is numbered and run range by range from the state that the last one came to, which
is written beside the output, so that no task holds the stream.

Output goes to a folder for each micro-batch, which is written anew if the batch is run again; so a restart leaves what one run
without it would have left. Elements come in order: those of a micro-batch are sorted, and one that is older than what its stream
had in an earlier batch is an error, or dropped and counted if `late` says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, DataType, LongType, StructField, StructType

from streamloom.operators import indexing
from streamloom.sources import files as store
from streamloom.sources import sinks
from streamloom.streaming import managed

#: The state store that keeps state by key in any number of columns.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Machine(StatefulProcessor):
    """managed.step() over the rows of a key, batch after batch."""

    def __init__(self, order: StructType, argument: DataType, late: str):
        fields = [StructField("open", BooleanType()), StructField("ended", BooleanType()), StructField("some", BooleanType()), StructField("file_no", LongType()), StructField("argument", argument)]
        self.schema, self.order, self.late = StructType([*fields, *order.fields]), order.names, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("machine", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        place = lambda r: tuple(r[o] for o in self.order)
        found = sorted(rows, key=place)
        state, newest = managed.State(), None
        if self.kept.exists():
            kept = self.kept.get()
            state, newest = managed.State(*kept[:5]), tuple(kept[5:])
        if newest is not None and place(found[0]) < newest:
            if self.late == "raise":
                raise ValueError(f"an element of {tuple(key)} at {place(found[0])} is older than the last one at {newest}")
            found = [r for r in found if place(r) >= newest]
        if not found:
            return
        arguments = np.fromiter((r["argument"] for r in found), object, len(found))
        written, begins, file_no, argument, after = managed.step(np.array([r["signal"] for r in found]), arguments, state)
        self.kept.update((after.open, after.ended, after.some, after.file_no, after.argument, *place(found[-1])))
        for i in np.flatnonzero(written):
            yield Row(row=found[i]["row"], file_no=int(file_no[i]), begins=bool(begins[i]), suffix_argument=argument[i])

    def close(self) -> None:
        pass


def files(df: DataFrame, keys: list[str], order_by: list[str], signal: Column, argument: Column, late: str = "raise") -> DataFrame:
    """managed.files() of a streaming DataFrame, one stream for each key, in the order of columns of whole numbers or strings: its
    columns, file_no, begins (the first row of a file) and suffix_argument. late: "raise" or "drop" older elements.

    A micro-batch's rows of one key are held together in a task, so its size (maxFilesPerTrigger and the like) bounds that. Null keys are a key;
    a null order or signal is an error."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    sure = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"an element without {what}")).cast(_type(df, c)))
    order = [sure(F.col(f"`{c}`"), "a place").alias(f"o{i}") for i, c in enumerate(order_by)]
    key = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    fed = df.select(*key, whole, *order, sure(signal.cast("int"), "a signal").alias("signal"), argument.alias("argument"))
    kind = fed.schema["argument"].dataType
    places = StructType([fed.schema[f"o{i}"] for i in range(len(order_by))])
    schema = StructType([fed.schema["row"], StructField("file_no", LongType()), StructField("begins", BooleanType()), StructField("suffix_argument", kind)])
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    found = fed.groupBy(*(f"k{i}" for i in range(len(keys)))).transformWithState(_Machine(places, kind, late), schema, "append", "none")
    return found.select("row.*", "file_no", "begins", "suffix_argument")


def _type(df: DataFrame, column: Column) -> DataType:
    return df.select(column.alias("x")).schema["x"].dataType


def _batch(path: str, number: int) -> str:
    return f"{path}/batch={number:08d}"


def _csv(rows: DataFrame, order_by: list[str], name: Column, header: str, line: Column, path: str) -> None:
    """Lines of one micro-batch by name, the header before the first line of a file."""
    lines = F.when(F.col("begins"), F.array(F.lit(header), line)).otherwise(F.array(line))
    found = rows.select(*order_by, name.alias("name"), lines.alias("lines"))
    ordered = found.repartitionByRange("name", *order_by).sortWithinPartitions("name", *order_by)
    ordered.select("name", F.explode("lines").alias("value")).write.partitionBy("name").mode("overwrite").text(path)


def to_csv(rows: DataFrame, order_by: list[str], path: str, checkpoint: str, header: str, line: Column, prefix: Column | None = None, suffix: Column | None = None, **trigger) -> StreamingQuery:
    """files() to text: path/batch=<number>/name=<prefix><file number><suffix>, ordered parts. A file goes on in later batches; its
    header is in its first."""
    name = _name(prefix, suffix)
    return _start(rows, checkpoint, trigger, lambda df, n: _csv(df, order_by, name, header, line, _batch(path, n)))


def to_wav(rows: DataFrame, order_by: list[str], path: str, checkpoint: str, rate: float, bits: int = 16, value: str = "value", prefix: Column | None = None, suffix: Column | None = None, **trigger) -> StreamingQuery:
    """files() to WAV: path/batch=<number>/<prefix><file number><suffix>.wav, a folder of parts each."""
    name = F.concat(_name(prefix, suffix), F.lit(".wav"))

    def write(df: DataFrame, n: int) -> None:
        store.delete(df.sparkSession, _batch(path, n))
        sinks.wav_by_name(df.select(*order_by, F.col(value).alias("value"), name.alias("name")), ["name", *order_by], store.qualified(df.sparkSession, _batch(path, n)), rate, bits)

    return _start(rows, checkpoint, trigger, write)


def _name(prefix: Column | None, suffix: Column | None) -> Column:
    return sinks.names(suffix) if prefix is None else F.concat(F.coalesce(prefix.cast("string"), F.lit("")), sinks.names(suffix))


def _start(rows: DataFrame, checkpoint: str, trigger: dict, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    def once(df: DataFrame, n: int) -> None:
        # A foreachBatch reads its batch more than once; what the machine gave is held for that.
        held = df.persist()
        try:
            write(held, n)
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# -- a single stream -------------------------------------------------------------------------------------------------


def _state(spark: SparkSession, path: str, number: int) -> tuple[managed.State, int, list | None]:
    """What the batches before one have come to: the machine's state, the number of elements, the place of the last one."""
    before = [int(n[:-5]) for n in store.names(spark, f"{path}/_state") if n.endswith(".json") and n[0].isdigit() and int(n[:-5]) < number]
    if not before:
        return managed.State(), 0, None
    kept = json.loads(store.read(spark, f"{path}/_state/{max(before):08d}.json"))
    return managed.State(**kept["machine"]), kept["n"], kept["newest"]


def single(df: DataFrame, order_by: list[str], signal: Column, argument: Column, path: str, checkpoint: str, write: Callable[[DataFrame, str], None], **trigger) -> StreamingQuery:
    """A streaming DataFrame as one stream, in the order of columns of whole numbers or strings. write(rows, folder) gets each micro-batch's
    rows that are written, with idx (counted over all elements, in the place of a column of that name), file_no, begins and suffix_argument; csv_of() and wav_of() make one.
    Arguments are whole numbers, strings or null."""

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state, n, newest = _state(spark, path, number)
        place = F.struct(*order_by)
        met = batch.agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).first()
        if not met["n"]:
            return
        if newest is not None and list(met["first"]) < newest:
            raise ValueError(f"an element at {list(met['first'])} is older than the last one at {newest}")
        rows = indexing.dense_index(batch, order_by)
        found, after = managed.advance(rows.withColumn("idx", F.col("idx") + n), signal, argument, state)
        write(found, _batch(path, number))
        store.write(spark, f"{path}/_state/{number:08d}.json", json.dumps({"machine": vars(after), "n": n + met["n"], "newest": list(met["last"])}))

    return _start(df, checkpoint, trigger, advance)


def csv_of(header: str, line: Column, suffix: Column | None = None) -> Callable[[DataFrame, str], None]:
    """Lines of a single stream, as of to_csv()."""
    return lambda rows, folder: _csv(rows, ["idx"], sinks.names(suffix), header, line, folder)


def wav_of(rate: float, bits: int = 16, suffix: Column | None = None) -> Callable[[DataFrame, str], None]:
    """Samples of a single stream, as of to_wav()."""

    def write(rows: DataFrame, folder: str) -> None:
        store.delete(rows.sparkSession, folder)
        named = rows.select("idx", "value", F.concat(sinks.names(suffix), F.lit(".wav")).alias("name"))
        sinks.wav_by_name(named, ["idx"], store.qualified(rows.sparkSession, folder), rate, bits)

    return write
