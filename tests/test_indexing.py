"""Positions: one shuffle, many ranges, and ranges that are found again."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from streamloom.operators import indexing


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_positions_over_many_ranges_without_a_window(many_ranges):
    df = many_ranges.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("v"))
    got = indexing.dense_index(df, ["k"])
    assert len(indexing.written(df, ["k"]).first_of()) > 4
    assert "Window" not in plan_of(got) and "Exchange hash" not in plan_of(got) and "Exchange range" not in plan_of(got)
    assert [r.idx for r in got.orderBy("k").select("idx").collect()] == list(range(10_000))
    sums = indexing.running_sum(df, F.col("v"), "before", "k").orderBy("k").collect()
    so_far = 0
    for r in sums:
        assert r.before == so_far
        so_far += r.v or 0
    empty = df.where("k < 0")
    assert indexing.dense_index(empty, ["k"]).count() == indexing.running_sum(empty, F.col("v"), "s", "k").count() == 0


def test_ranges_are_written_once_until_the_files_change(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"k": [3, 1, 2]}), path)
    read = lambda: indexing.written(spark.read.parquet(path), ["k"]).rows
    first = read().inputFiles()
    assert read().inputFiles() == first and indexing.written(spark.read.parquet(path).where("k > 1"), ["k"]).rows.inputFiles() != first
    indexing.forget()
    assert read().inputFiles() != first
    # The same name with other rows.
    pq.write_table(pa.table({"k": [9, 8, 7, 6]}), path)
    assert [r.k for r in indexing.dense_index(spark.read.parquet(path), ["k"]).orderBy("idx").collect()] == [6, 7, 8, 9]
    drawn = spark.read.parquet(path).withColumn("r", F.rand())
    assert indexing.written(drawn, ["k"]).rows.inputFiles() != indexing.written(drawn, ["k"]).rows.inputFiles()


def test_carried_values_start_anew_with_each_key(many_ranges):
    df = many_ranges.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("k"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    rows, part, place = indexing.ranged(df, ["k", "id"])
    out = indexing.carry(rows, part, place, F.col("v"), "seen", "last", keys=["k"])
    out = indexing.carry(out, part, place, F.col("v"), "total", "sum", True, keys=["k"]).collect()
    want = {}
    for r in sorted(out, key=lambda r: r.id):
        last, total = want.get(r.k, (None, None))
        if r.v is not None:
            total = r.v + (total or 0)
        assert (r.seen, r.total) == (last, total)
        want[r.k] = (last if r.v is None else r.v, total)
    assert len(want) == 3
