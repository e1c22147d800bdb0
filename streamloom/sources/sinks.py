"""Text and function sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions.time import UNITS, rate_of
from streamloom.operators import indexing, spectral
from streamloom.plans.stream import Stream
from streamloom.scratch import materialize
from streamloom.sources import pcm
from streamloom.streaming import managed


def csv_lines(df: DataFrame, *cells: Column) -> DataFrame:
    """idx and line: cells joined by commas, with no quoting."""
    return df.select("idx", F.concat_ws(",", *(c.cast("string") for c in cells)).alias("line"))


def sample_lines(df: DataFrame, rate: float, unit: str = "ms", measure: int = 1) -> DataFrame:
    """time in whole units and value with ten decimals."""
    time = (F.col("idx") * measure / (F.lit(rate_of(rate)) / F.lit(1e9 / UNITS[unit]))).cast("long")
    return csv_lines(df, time, F.format_string("%.10f", F.col("value")))


def spectrum_lines(df: DataFrame, of: Callable[[Column], Column], unit: str = "ms") -> DataFrame:
    """time and one value for each frequency."""
    time = F.floor(spectral.time_ns(F.col("value")) / UNITS[unit]).cast("long")
    return df.select("idx", F.concat(time.cast("string"), F.lit(","), F.array_join(F.transform(of(F.col("value")), lambda x: F.format_string("%.10f", x)), ",")).alias("line"))


def spectrum_header(df: DataFrame) -> str:
    found = df.select(F.transform(spectral.frequency(F.col("value")), lambda x: F.format_string("%.5f", x)).alias("f")).first()
    return ",".join(["time ms \\ freq hz", *(found["f"] if found else [])])


def write_lines(lines: DataFrame, path: str, header: str | None = None, single: bool = False, charset: str = "UTF-8") -> None:
    """Text files whose names are in the order of idx, with the header as the first line of the first; single: one file, by one task."""
    named = lines.select("idx", F.col("line").alias("value"))
    if header is not None:
        named = lines.sparkSession.createDataFrame([(-1, header)], "idx long, value string").unionByName(named)
    df = named.coalesce(1).sortWithinPartitions("idx") if single else named.orderBy("idx")
    df.select("value").write.mode("overwrite").option("encoding", charset).text(path)


def to_csv_of(stream: Stream, spark: SparkSession, path: str, header: list[str], cells: Callable[[Column, float, Column], list[Column]], rate: float = 44100.0, single: bool = False, charset: str = "UTF-8") -> None:
    """Any elements: cells(position, rate, value) gives a line's columns; position counts elements."""
    stream.check_rate(rate)
    at = stream.rate or rate
    write_lines(csv_lines(stream.build(spark, rate), *cells(F.col("idx"), rate_of(at), F.col("value"))), path, ",".join(header), single, charset)


def to_csv(stream: Stream, spark: SparkSession, path: str, rate: float = 44100.0, unit: str = "ms", single: bool = False, charset: str = "UTF-8") -> None:
    """Samples as time and value."""
    stream.check_rate(rate)
    write_lines(sample_lines(stream.build(spark, rate), stream.rate or rate, unit, stream.measure), path, f"time {unit},value", single, charset)


def magnitude_to_csv(stream: Stream, spark: SparkSession, path: str, rate: float = 44100.0, unit: str = "ms", single: bool = False) -> None:
    df = stream.build(spark, rate)
    write_lines(spectrum_lines(df, spectral.magnitude, unit), path, spectrum_header(df), single)


def phase_to_csv(stream: Stream, spark: SparkSession, path: str, rate: float = 44100.0, unit: str = "ms", single: bool = False) -> None:
    df = stream.build(spark, rate)
    write_lines(spectrum_lines(df, spectral.phase, unit), path, spectrum_header(df), single)


def names(suffix: Column | None) -> Column:
    """The name of each row's managed file: file_no keeps files apart whose suffixes are equal."""
    tail = F.coalesce((F.col("suffix_argument") if suffix is None else suffix).cast("string"), F.lit(""))
    # Not nullable: the writer then keeps the order within a name instead of sorting by names again.
    return F.coalesce(F.concat(F.lpad(F.col("file_no").cast("string"), 8, "0"), tail), F.lit(""))


def managed_csv(df: DataFrame, signal: Column, argument: Column, path: str, header: str, line: Callable[[Column], Column], suffix: Column | None = None) -> DataFrame:
    """Elements (idx, value) with signals in band to text, a folder path/name=<number><suffix> for each file of ordered parts, each with
    the header. idx counts on while a gate is closed. Returns name, n_lines and n_parts."""
    found = managed.files(df, signal, argument).select("idx", names(suffix).alias("name"), line(F.col("value")).alias("value"))
    heads = found.select("name").distinct().select(F.lit(-1).cast("long").alias("idx"), "name", F.lit(header).alias("value"))
    ordered = heads.unionByName(found).repartitionByRange("name", "idx").sortWithinPartitions("name", "idx")
    ordered.select("name", "value").write.partitionBy("name").mode("overwrite").text(path)
    written = df.sparkSession.read.schema("value string, name string").text(path)
    return written.select("name", F.input_file_name().alias("f")).groupBy("name").agg((F.count("*") - 1).alias("n_lines"), F.count_distinct("f").alias("n_parts"))


def managed_wav(df: DataFrame, signal: Column, argument: Column, path: str, rate: float, bits: int = 16, suffix: Column | None = None, whole: bool = False) -> DataFrame:
    """Samples (idx, value) with signals in band to WAV, a folder path/<number><suffix>.wav of parts for each file. whole: with the samples that
    the bits can't hold (see pcm). Returns name, part, n_samples and n_bytes."""
    found = managed.files(df, signal, argument).select("idx", "value", "file_no", F.concat(names(suffix), F.lit(".wav")).alias("name"))
    return wav_by_name(found, ["idx"], path, rate, bits, whole)


def wav_by_name(found: DataFrame, order_by: list[str], path: str, rate: float, bits: int = 16, whole: bool = False) -> DataFrame:
    """Samples (value, name) to WAV, a folder of parts for each name."""
    # Within a file elements may be missing where a gate was closed, so places are counted along the whole stream.
    counted = indexing.dense_index(found, order_by, "before")
    starts = counted.groupBy("name").agg(F.min("before").alias("start"))
    dense = counted.join(starts, "name").select((F.col("before") - F.col("start")).alias("idx"), "value", "name")
    return pcm.write_wav_parts(dense, path, rate, bits, names="name", whole=whole)


def to_function(stream: Stream, spark: SparkSession, fn: Callable[[str, int, Any], bool], rate: float = 44100.0) -> None:
    """fn(phase, position, value) for each element in order on the driver, one partition held at a time; phases "write", until fn
    returns False, "end" if the stream ended, "close"."""
    n, ended = 0, True
    for n, value in enumerate(stream.collect(spark, rate), 1):
        if not fn("write", n - 1, value):
            ended = False
            break
    if ended:
        fn("end", n, None)
    fn("close", n, None)


def to_function_in_tasks(stream: Stream, spark: SparkSession, make: Callable[[int], Callable[[str, int, Any], bool]], rate: float = 44100.0) -> list[tuple[int, int, bool]]:
    """As to_function(), but each range of the stream in a task of its own: make(first position) gives a function there, which is called for the
    range's elements in order, phases "write", until it returns False, "end" if the range ended, "close". Ranges run side by side, so a
    False stops its range alone; a task that is run again calls anew, so functions should write what can be written twice, as files named by
    the first position. Returns the first position, the number of elements written and whether it ended, of each range in order."""
    stream.check_rate(rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, first, at, n, ended = None, 0, 0, 0, True
        for b in batches:
            if b.num_rows and fn is None:
                first = b.column("idx")[0].as_py()
                fn = make(first)
            for at, value in zip(b.column("idx").to_pylist(), b.column("value").to_pylist(), strict=True) if ended else ():
                ended = bool(fn("write", at, value))
                if not ended:
                    break
                n += 1
        if fn is not None:
            if ended:
                fn("end", at + 1, None)
            fn("close", at + 1, None)
            yield pa.RecordBatch.from_pydict({"first": [first], "n": [n], "ended": [ended]})

    ordered = stream.build(spark, rate).select("idx", "value").repartitionByRange("idx").sortWithinPartitions("idx")
    found = materialize(ordered.mapInArrow(run, "first long, n long, ended boolean"), "function-sink")
    return sorted(tuple(r) for r in found.collect())


def to_dev_null(stream: Stream, spark: SparkSession, rate: float = 44100.0) -> None:
    stream.check_rate(rate)
    stream.build(spark, rate).write.format("noop").mode("overwrite").save()
