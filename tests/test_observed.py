"""Metrics of running plans, the rule for late values, and windows by panes."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamloom.functions import metrics
from streamloom.operators import windows
from streamloom.plans.stream import Stream
from streamloom.streaming.observed import Collector, Metric, RollUp


def test_rollups_reject_late_values():
    r = RollUp("counter", 100, keep=3)
    assert [r.append(v, at) for v, at in ((1, 10), (2, 10), (5, 9), (3, 110), (4, 99))] == [True, True, False, True, False]
    assert r.values == {0: 3, 1: 3}
    for at in (250, 360, 470):
        r.append(1, at)
    assert sorted(r.values) == [2, 3, 4]
    g = RollUp("gauge", 100)
    for v, at in (((False, 2), 1), ((True, 7), 2), ((False, 3), 3), ((False, 1), 150)):
        g.append(v, at)
    assert g.values == {0: (True, 10), 1: (False, 1)}


def test_batches_and_streams_tell_their_metrics(spark, tmp_path):
    c = Collector(1000)
    rows, spent = Metric.of("counter", "rows", table="a"), Metric.of("time", "spent")
    df = c.observe(spark.range(1000), "b", rows.column(), spent.column(F.col("id") % 3))
    df.where("id < 10").write.format("noop").mode("overwrite").save()
    c.done("b", 5)
    assert c.total(Metric.of("counter", "rows")) == 1000 and c.total(Metric.of("counter", "rows", table="z")) is None
    assert c.total(spent) == (1000, sum(i % 3 for i in range(1000)))
    live = Collector(1000)
    spark.streams.addListener(live)
    try:
        for k in range(3):
            spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        gauge = Metric.of("gauge", "top")
        seen = live.observe(s, "s", rows.column(), Metric.of("counter", "sum").column(F.col("id")), gauge.column(F.col("id"), F.col("id") == 20))
        seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if live.total(rows) == 30:
                break
            time.sleep(0.1)
        assert live.total(rows) == 30 and live.total(Metric.of("counter", "sum")) == sum(range(30)) and live.total(gauge) == (True, sum(range(20, 30))) and not live.late
    finally:
        spark.streams.removeListener(live)
    with pytest.raises(ValueError):
        Metric.of("other", "x")


def test_late_values_of_a_table(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = np.random.default_rng(1).integers(0, 50, 300).tolist()
        df = spark.createDataFrame([(i, None if i % 40 == 7 else t) for i, t in enumerate(at)], "n long, t long")
        good, late = metrics.accepted(df, F.col("t"), ["n"])
        newest, want = -1, []
        for i, t in enumerate(at):
            if i % 40 != 7 and t >= newest:
                want.append(i)
                newest = t
        assert sorted(r.n for r in good.collect()) == want and sorted(r.n for r in late.collect()) == sorted(set(range(300)) - set(want))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 200), st.integers(2, 40), st.integers(1, 50), st.integers(1, 30))
def test_folds_equal_windows(spark, n, size, step, block):
    x = [None if i % 11 == 3 else float((i * 37) % 101) for i in range(n)]
    s = Stream.from_list(spark, x)
    df = s.build(spark)
    of = lambda w: [v for v in x[w * step : w * step + size] if v is not None]
    starts = range(-(-n // step))
    for how, fn in (("sum", sum), ("count", len), ("min", lambda v: min(v, default=None)), ("max", lambda v: max(v, default=None))):
        got = [r.value for r in windows.fold(df, size, step, how, block).orderBy("idx").collect()]
        assert got == [fn(of(w)) for w in starts], (how, n, size, step, block)
