"""Named time-series tables: marker_ns and value in Parquet segments, with retention and queries by time.

A table is a folder of segments, each the rows of a stretch of time, and a log of commits. A commit adds and removes segments, with
their first and last marker and number of rows, and may say which batch of a stream it holds or that nothing follows. It is one
file, put in place whole and only if no other writer was faster, who else looks at the table again: so late rows are found for any
number of writers, a batch that is repeated is written once, and readers see a table before or after a commit. Queries by time
read the segments they meet, markers come from the log, and retention drops segments whole.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from streamloom.functions.time import TimeMeasure, rate_of
from streamloom.plans.stream import Stream
from streamloom.sources import files

DAY = TimeMeasure(1, "d")
NS_MIN, NS_MAX = -(1 << 63), (1 << 63) - 1

#: Every so many commits one says all that the table holds.
WHOLE_EVERY = 50

#: A row that is older than the last one when it is appended.
LATE = "a row at {} ns is older than the last one at {} ns"


@dataclass(frozen=True)
class Segment:
    """A file of the table, and what is in it."""

    path: str
    first: int
    last: int
    rows: int


@dataclass(frozen=True)
class Snapshot:
    """What a table holds after its commits up to `version` (0: none)."""

    version: int = 0
    segments: tuple[Segment, ...] = ()
    schema: str | None = None
    finished: bool = False
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def last(self) -> int | None:
        return max((s.last for s in self.segments), default=None)

    def after(self, commit: dict) -> Snapshot:
        whole = commit.get("whole")
        kept = [] if whole else [s for s in self.segments if s.path not in set(commit["remove"])]
        added = [Segment(**s) for s in (whole or commit["add"])]
        batches = {**self.batches, **({commit["writer"]: commit["batch"]} if commit.get("writer") else {}), **commit.get("batches", {})}
        return replace(self, version=commit["version"], segments=(*kept, *added), schema=commit.get("schema") or self.schema, finished=commit["finish"] or self.finished and not commit.get("reopen"), batches=batches)


def _name(version: int) -> str:
    return f"{version:020d}.json"


class TimeTable:
    """A table of (marker_ns, value) at a path, appended in order."""

    def __init__(self, spark: SparkSession, name: str, path: str, rate: float, retention: TimeMeasure = DAY, kind: str = "double"):
        self.spark, self.name, self.path, self.rate, self.retention, self.kind = spark, name, files.qualified(spark, path), rate_of(rate), retention, kind
        self._seen = Snapshot()

    # -- the log -------------------------------------------------------------------------------------------------

    @property
    def log(self) -> str:
        return f"{self.path}/_log"

    def snapshot(self) -> Snapshot:
        """The table as it is now; only commits that were not seen yet are read."""
        new = [n for n in files.names(self.spark, self.log) if n.endswith(".json") and n[0].isdigit() and int(n[:-5]) > self._seen.version]
        # From the newest commit that says all, if any is among the new ones.
        whole = [n for n in new if int(n[:-5]) % WHOLE_EVERY == 0]
        for n in new[new.index(whole[-1]) :] if whole else new:
            self._seen = self._seen.after(json.loads(files.read(self.spark, f"{self.log}/{n}")))
        return self._seen

    def _commit(self, make: Callable[[Snapshot], dict | None]) -> Snapshot:
        """Put make(snapshot) into the log, again with a newer snapshot as long as other writers are faster; None: nothing to do."""
        while True:
            now = self.snapshot()
            found = make(now)
            if found is None:
                return now
            commit = {"version": now.version + 1, "add": [], "remove": [], "finish": False, "append": False} | found
            if commit["version"] % WHOLE_EVERY == 0:
                then = now.after(commit)
                commit |= {"whole": [vars(s) for s in then.segments], "batches": then.batches, "schema": then.schema, "finish": then.finished}
            if files.put_new(self.spark, f"{self.log}/{_name(commit['version'])}", json.dumps(commit)):
                return self.snapshot()

    # -- writing -------------------------------------------------------------------------------------------------

    def append(self, df: DataFrame, writer: str | None = None, batch: int | None = None, finish: bool = False) -> bool:
        """Add rows, in one commit; they may not be older than the last one. writer, batch: the number of these rows in a series of
        batches; what is in the table already is not written again. Returns whether rows were written."""
        if writer is not None and self.snapshot().batches.get(writer, -1) >= batch:
            return False
        rows = df.select(F.coalesce(F.col("marker_ns").cast("long"), F.raise_error(F.lit("a row without a marker")).cast("long")).alias("marker_ns"), "value")
        if self.snapshot().finished:
            raise ValueError(f"table {self.name} is finished")
        added = self._segments(rows)
        did = []

        def make(now: Snapshot) -> dict | None:
            did.clear()
            if writer is not None and now.batches.get(writer, -1) >= batch:
                return None
            if now.finished:
                raise ValueError(f"table {self.name} is finished")
            first = min((s.first for s in added), default=None)
            if first is not None and now.last is not None and first < now.last:
                raise ValueError(LATE.format(first, now.last))
            did.append(True)
            return {"add": [vars(s) for s in added], "append": True, "schema": rows.schema.json(), "finish": finish} | ({"writer": writer, "batch": batch} if writer is not None else {})

        try:
            self._commit(make)
        finally:
            if not did:
                for s in added:
                    files.delete(self.spark, s.path)
        return bool(did)

    def _segments(self, rows: DataFrame) -> list[Segment]:
        """Written files of rows, each with a stretch of time; a row for each of them comes to the driver."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartitionByRange("marker_ns").sortWithinPartitions("marker_ns").write.parquet(folder)
        found = self.spark.read.schema(rows.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("f"))
        listed = found.agg(F.min("marker_ns").alias("first"), F.max("marker_ns").alias("last"), F.count("*").alias("n")).collect()
        return sorted((Segment(f"{folder}/{r.f}", r["first"], r["last"], r.n) for r in listed), key=lambda s: (s.first, s.last, s.path))

    def write(self, stream: Stream, finish: bool = True, buffer: int = 0) -> None:
        """Append a finite stream: markers go on from the last one, an element's length apart. finish: nothing
        may follow; else more can be written. buffer: rows are vectors of so many samples."""
        stream = stream.vectors(buffer) if buffer else stream
        stream.check_rate(self.rate)
        last, m = self.last_marker(), stream.measure
        start = 0 if last is None else round(last / 1e9 * self.rate) + m
        df = stream.build(self.spark, self.rate)
        self.append(df.select(marker(F.col("idx") * m + start, self.rate).alias("marker_ns"), "value"), finish=finish)

    def write_stream(self, df: DataFrame, checkpoint: str, writer: str = "stream", **trigger) -> StreamingQuery:
        """A query that appends a streaming DataFrame of marker_ns and value, a commit for each micro-batch. A batch that is run again after a
        restart is in the log already; rows that are older than the last one of an earlier batch fail the query in their batch."""
        query = df.select("marker_ns", "value").writeStream.foreachBatch(lambda rows, number: self.append(rows, writer, number) and None)
        return query.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def finish(self) -> None:
        """Nothing may follow; readers that follow the table end."""
        self.finished = True

    @property
    def finished(self) -> bool:
        return self.snapshot().finished

    @finished.setter
    def finished(self, done: bool) -> None:
        """Finish the table, or open it again."""
        self._commit(lambda now: None if now.finished == done else {"finish": done, "reopen": not done})

    def cleanup(self) -> int:
        """Remove the rows that retention does not keep, and return their number: whole segments from the log, and in the place of those
        that it cuts new ones with what stays. Files stay until vacuum(), so readers go on."""
        gone = 0

        def make(now: Snapshot) -> dict | None:
            nonlocal gone
            cut = self._cut(now)
            old = [s for s in now.segments if s.first <= cut] if cut is not None else []
            part = [s for s in old if s.last > cut] if old else []
            kept = self._segments(self._read(now, part).where(F.col("marker_ns") > cut)) if part else []
            gone = sum(s.rows for s in old) - sum(s.rows for s in kept)
            return {"add": [vars(s) for s in kept], "remove": [s.path for s in old]} if old else None

        self._commit(make)
        return gone

    def vacuum(self) -> int:
        """Delete files that the table does not hold, left by cleanup() and by writers that failed; there must be no other writer, and
        no reader of an earlier state. Returns their number."""
        held = {s.path for s in self.snapshot().segments}
        found = [f"{self.path}/data/{d}/{n}" for d in files.names(self.spark, f"{self.path}/data") for n in files.names(self.spark, f"{self.path}/data/{d}") if n.endswith(".parquet")]
        lost = [f for f in found if f not in held]
        for f in lost:
            files.delete(self.spark, f)
        return len(lost)

    def reset(self) -> None:
        """Empty the table and open it again."""
        files.delete(self.spark, self.path)
        self._seen = Snapshot()

    # -- reading -------------------------------------------------------------------------------------------------

    def _cut(self, now: Snapshot) -> int | None:
        """Rows up to this marker are beyond retention."""
        return None if now.last is None else now.last - self.retention.ns

    def _read(self, now: Snapshot, segments: list[Segment]) -> DataFrame:
        schema = StructType.fromJson(json.loads(now.schema)) if now.schema else f"marker_ns bigint, value {self.kind}"
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(s.path for s in segments))

    def _between(self, low: int, high: int) -> DataFrame:
        """What retention keeps from marker low up to before high; other segments are not read."""
        now = self.snapshot()
        cut = self._cut(now)
        low = low if cut is None else max(low, cut + 1)
        rows = self._read(now, [s for s in now.segments if s.last >= low and s.first < high])
        return rows.where((F.col("marker_ns") >= low) & (F.col("marker_ns") < high))

    def rows(self) -> DataFrame:
        """What retention keeps: rows later than the last marker less the retention."""
        return self._between(NS_MIN, NS_MAX)

    def first_marker(self) -> int | None:
        """From the log, unless retention cuts a segment, of which the first row is then looked for."""
        now = self.snapshot()
        if now.last is None:
            return None
        cut = self._cut(now)
        kept = [s for s in now.segments if s.last > cut]
        first = min(kept, key=lambda s: s.first)
        return first.first if first.first > cut else self._read(now, [s for s in kept if s.first <= cut]).where(F.col("marker_ns") > cut).agg(F.min("marker_ns")).first()[0]

    def last_marker(self) -> int | None:
        return self.snapshot().last

    def last(self, interval: TimeMeasure) -> DataFrame:
        """(last - interval, last]."""
        top = self.last_marker()
        return self.rows() if top is None else self._between(top - interval.ns + 1, top + 1)

    def time_range(self, start: TimeMeasure, end: TimeMeasure) -> DataFrame:
        """[start, end)."""
        return self._between(start.ns, end.ns)

    def since(self, offset: TimeMeasure) -> DataFrame:
        """What there is from that long before the last row on, that one included."""
        top = self.last_marker()
        return self.rows() if top is None else self._between(top - offset.ns, NS_MAX)

    def stream(self, kind: str = "sample") -> Stream:
        """The table as a stream."""
        return Stream.from_df(self.rows(), ["marker_ns"], "value", self.rate)

    def follow(self, offset: TimeMeasure) -> DataFrame:
        """A streaming DataFrame from `offset` before the last row on, with the rows of commits that come later. Its offsets are versions of the
        log, so a query goes on after a restart where it was, whatever retention has dropped since."""
        now = self.snapshot()
        if now.schema is None:
            raise ValueError(f"table {self.name} has no rows yet")
        self.spark.dataSource.register(TableStream)
        start = NS_MIN if now.last is None else now.last - offset.ns
        return self.spark.readStream.format("streamloom_table").schema(StructType.fromJson(json.loads(now.schema))).option("path", self.path).option("start", str(start)).load()

    def until_finished(self, query: StreamingQuery, poll: float = 0.2) -> None:
        """Let a query over follow() run until the table is finished and all its rows have gone through, and end it."""
        while query.isActive:
            if self.finished:
                query.processAllAvailable()
                query.stop()
            time.sleep(poll)
        if (failed := query.exception()) is not None:
            raise failed


@dataclass
class _Piece(InputPartition):
    path: str
    start: int


class TableStream(DataSource):
    """The segments that commits have appended to a table, as a stream; offsets are versions of its log."""

    @classmethod
    def name(cls) -> str:
        return "streamloom_table"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TableReader(self.options["path"], int(self.options["start"]), [f.name for f in schema.fields])


class _TableReader(DataSourceStreamReader):
    def __init__(self, path: str, start: int, columns: list[str]):
        self.path, self.start, self.columns = path, start, columns

    def _log(self) -> tuple[pafs.FileSystem, str]:
        store, root = pafs.FileSystem.from_uri(self.path)
        return store, f"{root}/_log"

    def initialOffset(self) -> dict:
        return {"version": 0, "start": self.start}

    def latestOffset(self) -> dict:
        store, log = self._log()
        found = [int(f.base_name[:-5]) for f in store.get_file_info(pafs.FileSelector(log, allow_not_found=True)) if f.base_name.endswith(".json") and f.base_name[0].isdigit()]
        return {"version": max(found, default=0), "start": self.start}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, log = self._log()
        out = []
        for version in range(start["version"] + 1, end["version"] + 1):
            with store.open_input_stream(f"{log}/{_name(version)}") as f:
                commit = json.loads(f.read())
            # The marker that the query began at, which a restart takes from its checkpoint; commits only go on in time.
            out += [_Piece(s["path"], start["start"]) for s in commit["add"] if commit["append"] and s["last"] >= start["start"]]
        return out

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(partition.path)
        with store.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(columns=self.columns):
                kept = b.filter(pc.greater_equal(b.column("marker_ns"), partition.start))
                if kept.num_rows:
                    yield kept

    def commit(self, end: dict) -> None:
        pass


def marker(samples, rate: float):
    """Whole nanoseconds of a sample count."""
    return (samples / (F.lit(rate_of(rate)) / F.lit(1e9))).cast("long")


def last(rows: DataFrame, interval: TimeMeasure) -> DataFrame:
    """(last - interval, last]."""
    top = rows.agg(F.max("marker_ns")).scalar()
    return rows.where((F.col("marker_ns") > top - interval.ns) & (F.col("marker_ns") <= top))


def time_range(rows: DataFrame, start: TimeMeasure, end: TimeMeasure) -> DataFrame:
    """[start, end)."""
    return rows.where((F.col("marker_ns") >= start.ns) & (F.col("marker_ns") < end.ns))


def retained(rows: DataFrame, retention: TimeMeasure) -> DataFrame:
    """Rows later than the last marker less the retention."""
    return rows.where(F.col("marker_ns") > rows.agg(F.max("marker_ns")).scalar() - retention.ns)


class Registry:
    """Tables by name."""

    def __init__(self) -> None:
        self.tables: dict[str, TimeTable] = {}

    def register(self, table: TimeTable) -> TimeTable:
        if table.name in self.tables:
            raise ValueError(f"table {table.name} is registered already")
        self.tables[table.name] = table
        return table

    def unregister(self, name: str) -> TimeTable | None:
        return self.tables.pop(name, None)

    def exists(self, name: str) -> bool:
        return name in self.tables

    def by_name(self, name: str) -> TimeTable:
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        return self.tables[name]

    def query(self, name: str, of: str, *times: TimeMeasure) -> DataFrame:
        """The rows of a table by name; of: "last" (interval), "time_range" (from, to), or "stream" (offset: what there is from that
        long before the last row on; TimeTable.follow() goes on with what comes later)."""
        table = self.by_name(name)
        return {"last": table.last, "time_range": table.time_range, "stream": table.since}[of](*times)

    def reset(self, name: str) -> None:
        self.by_name(name).reset()
