"""Tables over a log of segments: writers, streams, readers that follow, retention."""

import threading

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from streamloom.functions.time import TimeMeasure
from streamloom.sources import tables
from streamloom.sources.tables import TimeTable


def rows(spark, start, n=10, value=0.0):
    return spark.range(start, start + n).select((F.col("id") * 1000).alias("marker_ns"), (F.col("id") + value).cast("double").alias("value"))


def markers(df):
    return sorted(r.marker_ns // 1000 for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return TimeTable(spark, "t", str(tmp_path / "t"), 1e6)


def test_queries_read_the_segments_they_meet(table, spark):
    for k in range(6):
        table.append(rows(spark, 10 * k))
    every = table.rows()
    some = table.time_range(TimeMeasure(12_000, "ns"), TimeMeasure(20_000, "ns"))
    assert markers(some) == list(range(12, 20)) and len(some.inputFiles()) < len(every.inputFiles())
    last = table.last(TimeMeasure(10_000, "ns"))
    assert markers(last) == list(range(50, 60)) and len(last.inputFiles()) == len(some.inputFiles())
    assert markers(table.since(TimeMeasure(10_000, "ns"))) == list(range(49, 60))
    assert (table.first_marker(), table.last_marker()) == (0, 59_000)
    assert table.time_range(TimeMeasure(1, "s"), TimeMeasure(2, "s")).count() == 0


def test_empty_table(table):
    assert table.rows().count() == 0 and table.first_marker() is None and table.last_marker() is None
    assert table.last(TimeMeasure(1, "s")).count() == 0 and table.cleanup() == 0
    with pytest.raises(ValueError):
        table.follow(TimeMeasure(0, "ns"))
    assert dict(TimeTable(table.spark, "v", table.path, 1e6, kind="array<double>").rows().dtypes)["value"] == "array<double>"


def test_late_rows_whoever_wrote_the_others(table, spark):
    other = TimeTable(spark, "u", table.path, 1e6)
    table.append(rows(spark, 0))
    other.append(rows(spark, 9, 5))
    assert table.last_marker() == 13_000
    with pytest.raises(ValueError, match="older"):
        table.append(rows(spark, 12, 3))
    assert markers(table.rows()) == sorted([*range(10), *range(9, 14)]) and table.vacuum() == 0
    with pytest.raises(Exception, match="without a marker"):
        table.append(spark.sql("select cast(null as long) marker_ns, 1.0D value"))


def test_writers_at_the_same_time(spark, tmp_path):
    """All put the same marker, so that none is late; none may be lost."""
    failed = []

    def put(k):
        try:
            TimeTable(spark, f"w{k}", str(tmp_path / "t"), 1e6).append(rows(spark, 5, 1, k))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=put, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = TimeTable(spark, "all", str(tmp_path / "t"), 1e6)
    assert not failed and sorted(r.value for r in found.rows().collect()) == [5.0 + k for k in range(6)] and found.snapshot().version == 6


def test_commits_that_say_all(table, spark, monkeypatch):
    monkeypatch.setattr(tables, "WHOLE_EVERY", 3)
    for k in range(7):
        assert table.append(rows(spark, 10 * k), "w", k)
    table.finish()
    new = TimeTable(spark, "n", table.path, 1e6)
    assert new.snapshot() == table.snapshot() and new.finished and markers(new.rows()) == list(range(70))
    assert not new.append(rows(spark, 0), "w", 6)
    with pytest.raises(ValueError, match="finished"):
        new.append(rows(spark, 100), "w", 7)


def test_retention_drops_segments_and_cuts_one(table, spark):
    table.retention = TimeMeasure(25_000, "ns")
    for k in range(6):
        table.append(rows(spark, 10 * k))
    assert markers(table.rows()) == list(range(35, 60)) and table.first_marker() == 35_000
    reader = table.rows()
    assert table.cleanup() == 35 and table.cleanup() == 0
    assert markers(table.rows()) == list(range(35, 60)) == markers(reader) and table.first_marker() == 35_000
    assert table.vacuum() > 0 and markers(TimeTable(spark, "u", table.path, 1e6, TimeMeasure(1, "d")).rows()) == list(range(35, 60))


def feed(spark, path, *parts):
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema("marker_ns long, value double").option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_is_written_once_also_after_a_restart(table, spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    feed(spark, path, rows(spark, 0), rows(spark, 10))
    table.write_stream(source(spark, path), checkpoint).awaitTermination()
    assert markers(table.rows()) == list(range(20)) and table.snapshot().batches == {"stream": 1}
    # The query's own note of its last batch is lost, so it runs that one again.
    (tmp_path / "checkpoint/commits/1").unlink()
    (tmp_path / "checkpoint/commits/.1.crc").unlink(missing_ok=True)
    feed(spark, path, rows(spark, 20))
    table.write_stream(source(spark, path), checkpoint).awaitTermination()
    assert markers(table.rows()) == list(range(30)) and table.snapshot().batches == {"stream": 2}


def test_late_rows_fail_in_their_batch(table, spark, tmp_path):
    path = str(tmp_path / "in")
    feed(spark, path, rows(spark, 10), rows(spark, 0))
    with pytest.raises(StreamingQueryException, match="older"):
        table.write_stream(source(spark, path), str(tmp_path / "checkpoint")).awaitTermination()
    assert markers(table.rows()) == list(range(10, 20))


def test_reader_follows_to_the_end(table, spark, tmp_path):
    table.append(rows(spark, 0))
    table.retention = TimeMeasure(12_000, "ns")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def start():
        return table.follow(TimeMeasure(4_000, "ns")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()

    query = start()
    query.processAllAvailable()
    table.append(rows(spark, 10))
    query.processAllAvailable()
    query.stop()
    # Goes on from its version, though retention has dropped what came before; what cleanup writes anew is not read twice.
    table.append(rows(spark, 20))
    assert table.cleanup() > 0
    query = start()

    def later():
        table.append(rows(spark, 30))
        table.finish()

    writer = threading.Thread(target=later)
    writer.start()
    table.until_finished(query)
    writer.join()
    assert not query.isActive and markers(spark.read.parquet(out)) == list(range(5, 40))
