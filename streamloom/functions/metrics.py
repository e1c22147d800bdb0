"""Metrics over time: roll-ups of counters, timers and gauges in buckets of a granularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.operators import indexing


def bucket(timestamp: Column, granularity: int) -> Column:
    return F.floor(timestamp / F.lit(granularity)).cast("long")


def accepted(df: DataFrame, timestamp: Column, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """Values that a roll-up takes, in the order in which they arrive, and those that are too late: their time is before that of one
    that came earlier. A null time is too late. The newest time so far is carried range by range."""
    rows, part, place = indexing.ranged(df.withColumn("_at", timestamp), arrival)
    seen = indexing.carry(rows, part, place, F.col("_at"), "_newest", "max").drop(part, place)
    late = F.col("_at").isNull() | F.coalesce(F.col("_at") < F.col("_newest"), F.lit(False))
    return seen.where(~late).drop("_at", "_newest"), seen.where(late).drop("_at", "_newest")


def counter_rollup(df: DataFrame, timestamp: Column, value: Column, granularity: int, *tags: str) -> DataFrame:
    """The sum of each bucket."""
    return df.groupBy(*tags, bucket(timestamp, granularity).alias("bucket")).agg(F.sum(value).alias("value"))


def time_rollup(df: DataFrame, timestamp: Column, elapsed: Column, granularity: int, *tags: str) -> DataFrame:
    """Number and sum of each bucket."""
    return df.groupBy(*tags, bucket(timestamp, granularity).alias("bucket")).agg(F.count(elapsed).alias("n"), F.sum(elapsed).alias("total"))


def gauge_rollup(df: DataFrame, timestamp: Column, is_set: Column, value: Column, order: list[str], granularity: int, *tags: str) -> DataFrame:
    """Each bucket's gauge: the last value set and the increments after it, or the increments alone (is_set false). Where a bucket was last
    set is an aggregate that its rows meet in a join, so a bucket of any size is many tasks."""
    keys = [*tags, "bucket"]
    rows = df.select(*tags, F.struct(*order).alias("_at"), bucket(timestamp, granularity).alias("bucket"), F.coalesce(is_set, F.lit(False)).alias("_set"), value.alias("_v"))
    last = rows.groupBy(*keys).agg(F.max(F.when(F.col("_set"), F.col("_at"))).alias("_last")).toDF(*(f"_k{i}" for i in range(len(keys))), "_last")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = rows.join(last, same).where(F.col("_last").isNull() | (F.col("_at") >= F.col("_last")))
    return met.groupBy(*keys).agg(F.sum("_v").alias("value"), F.max("_last").isNotNull().alias("is_set"))


def is_super_of(tags: Column, wanted: dict[str, str]) -> Column:
    """Whether a map of tags has all wanted ones."""
    test = F.lit(True)
    for k, v in wanted.items():
        test = test & (F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")) == v)
    return test


def timed(rollup: DataFrame, granularity: int, newest: Column) -> DataFrame:
    """A roll-up with the time of each bucket: its start, but for the last bucket, which is open, its newest value's time."""
    top = rollup.agg(F.max("bucket")).scalar()
    return rollup.withColumns({"is_open": F.col("bucket") == top, "at": F.when(F.col("bucket") == top, newest).otherwise(F.col("bucket") * granularity).cast("long")})


def in_last(rows: DataFrame, interval: int, now: int, total: Column) -> DataFrame:
    """One row with the aggregate over what timed() has of the last interval: closed buckets that start in it, and the open one if its
    newest value is later than the interval's start, or if there is no other."""
    closed = ~F.col("is_open") & (F.col("at") >= now - interval)
    found = rows.agg(F.count_if(closed).alias("n")).select("n")
    none = found.scalar() == 0
    return rows.where(closed | (F.col("is_open") & ((F.col("at") > now - interval) | none))).agg(total)


def remove_all_before(rows: DataFrame, before: int) -> tuple[DataFrame, DataFrame]:
    """What stays of timed(), and what goes."""
    return rows.where(F.col("at") >= before), rows.where(F.col("at") < before)


def leave_only_last(rows: DataFrame, interval: int, now: int) -> DataFrame:
    """What timed() has of the last interval."""
    return rows.where(F.col("at") >= now - interval)


def merged(a: DataFrame, b: DataFrame, total: Column, *tags: str) -> DataFrame:
    """Two roll-ups of one granularity as one: buckets that both have are accumulated."""
    return a.unionByName(b).groupBy(*tags, "bucket").agg(total)
