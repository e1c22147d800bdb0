"""Metrics of running plans: counters, gauges and times that Spark observes while a plan runs, rolled up by time on the driver.

Aggregates travel with the plan (DataFrame.observe): a batch tells them once, a streaming query with each micro-batch. What the driver
holds is one value for each metric and bucket, of the buckets that are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from threading import Lock
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: How values of each kind are put together: sums of counts; the last gauge that was set, and what it rose by since; counts and sums of times.
COMBINE: dict[str, Callable[[Any, Any], Any]] = {
    "counter": lambda a, b: a + b,
    "gauge": lambda a, b: b if b[0] else (a[0], a[1] + b[1]),
    "time": lambda a, b: (a[0] + b[0], a[1] + b[1]),
}


@dataclass(frozen=True)
class Metric:
    """A metric object: its kind ("counter", "gauge" or "time"), name and tags."""

    kind: str
    name: str
    tags: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def of(kind: str, name: str, **tags: str) -> Metric:
        if kind not in COMBINE:
            raise ValueError(f"no kind of metric: {kind}")
        return Metric(kind, name, tuple(sorted(tags.items())))

    def is_super_of(self, other: Metric) -> bool:
        """Whether the other is this metric with all tags of this one."""
        return (self.kind, self.name) == (other.kind, other.name) and set(self.tags) <= set(other.tags)

    def column(self, value: Column | None = None, is_set: Column | None = None) -> Column:
        """The aggregate that is observed: rows, or the sum of value; for gauges increments; for times their number and sum."""
        if self.kind == "counter":
            return (F.count("*") if value is None else F.coalesce(F.sum(value), F.lit(0))).alias(self.key)
        if self.kind == "time":
            return F.struct(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total")).alias(self.key)
        return F.struct(F.coalesce(F.max(is_set) if is_set is not None else F.lit(False), F.lit(False)).alias("is_set"), F.coalesce(F.sum(value), F.lit(0)).alias("value")).alias(self.key)

    @property
    def key(self) -> str:
        return ";".join([self.kind, self.name, *(f"{k}={v}" for k, v in self.tags)])


@dataclass
class RollUp:
    """Values by bucket of `granularity` milliseconds; a value that is older than the last one is too late. The newest `keep` buckets stay."""

    kind: str
    granularity: int
    keep: int = 10_000
    values: dict[int, Any] = field(default_factory=dict)
    newest: int | None = None

    def append(self, value: Any, at: int) -> bool:
        if self.newest is not None and at < self.newest:
            return False
        self.newest, bucket = at, at // self.granularity
        self.values[bucket] = COMBINE[self.kind](self.values[bucket], value) if bucket in self.values else value
        while len(self.values) > self.keep:
            del self.values[min(self.values)]
        return True


class Collector(StreamingQueryListener):
    """Roll-ups of all metrics that plans of observe() tell. spark.streams.addListener(collector) makes it hear streaming queries."""

    def __init__(self, granularity: int = 60_000, keep: int = 10_000):
        super().__init__()
        self.granularity, self.keep, self.rollups, self.late, self._lock = granularity, keep, {}, 0, Lock()

    def take(self, found: dict[str, Any], at: int) -> None:
        """Values by key at a time in milliseconds."""
        with self._lock:
            for key, value in found.items():
                kind = key.split(";")[0]
                rollup = self.rollups.setdefault(key, RollUp(kind, self.granularity, self.keep))
                self.late += not rollup.append(value if kind == "counter" else tuple(value), at)

    def total(self, metric: Metric) -> Any:
        """Of all buckets and all metrics that this one is a super of, or None."""
        out = None
        for key, rollup in self.rollups.items():
            kind, name, *tags = key.split(";")
            if metric.is_super_of(Metric(kind, name, tuple(tuple(t.split("=", 1)) for t in tags))):
                for bucket in sorted(rollup.values):
                    out = rollup.values[bucket] if out is None else COMBINE[kind](out, rollup.values[bucket])
        return out

    def observe(self, df: DataFrame, name: str, *columns: Column) -> DataFrame:
        """df, which tells Metric.column()s when it runs. A streaming one tells this collector if it listens; for a batch call done()."""
        if df.isStreaming:
            return df.observe(name, *columns)
        self.batches = getattr(self, "batches", {})
        self.batches[name] = Observation(name)
        return df.observe(self.batches[name], *columns)

    def done(self, name: str, at: int) -> None:
        """Take what a batch has told; it waits for the plan's first action."""
        self.take(self.batches.pop(name).get, at)

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        at = int(datetime.fromisoformat(event.progress.timestamp.replace("Z", "+00:00")).timestamp() * 1000)
        for row in event.progress.observedMetrics.values():
            self.take({k: v for k, v in row.asDict().items() if k.split(";")[0] in COMBINE}, at)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass
