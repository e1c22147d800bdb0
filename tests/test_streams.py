"""Literal cases and laws of ordered streams."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamloom.functions import samples
from streamloom.functions.time import TimeMeasure, index_ceil, index_floor, samples_to_time
from streamloom.operators import indexing, spectral, windows
from streamloom.plans.stream import Stream
from streamloom.sources import pcm, sinks, tables
from streamloom.streaming import managed

FEW = settings(max_examples=8, deadline=None)


def ints(spark, n, start=0):
    return Stream.from_list(spark, [float(x) for x in range(start, start + n)])


def values(stream, spark, rate=1000.0, bound=None):
    return [round(x, 9) for x in stream.collect(spark, rate, bound)]


def test_merge_takes_the_longer_length(spark):
    assert values(ints(spark, 10) + ints(spark, 6, 10), spark) == [10, 12, 14, 16, 18, 20, 6, 7, 8, 9]
    assert values(ints(spark, 10) + ints(spark, 16, 10), spark) == [*range(10, 30, 2), *range(20, 26)]


def test_flatten_cases(spark):
    plus = lambda following, current: following + current
    w = ints(spark, 10).window(3, 2)
    assert values(w.flatten(plus, -1.0), spark) == [0, 1, 4, 3, 8, 5, 12, 7, 16, 9, -1]
    assert values(ints(spark, 10).window(3, 4).flatten(plus, -1.0), spark) == [0, 1, 2, -1, 4, 5, 6, -1, 8, 9, -1, -1]
    lists = Stream.from_list(spark, [[1.0, 2.0, 3.0], [4.0], [], [], [5.0, 6.0], [7.0], []], "array<double>")
    lists.kind = "vector"
    assert values(lists.flatten(), spark) == [1, 2, 3, 4, 5, 6, 7]
    assert values(lists.flat_map(lambda v: F.filter(v, lambda x: x % 2 == 0)), spark) == [2, 4, 6]


def test_flatten_of_mixed_windows(spark):
    grid = [(3, 2, [0, 1, 2]), (2, 1, [3, 4]), (4, 2, [5, 6, 7, 8]), (2, 1, [9, 10])]
    df = spark.createDataFrame([(i, (s, t, [float(x) for x in e])) for i, (s, t, e) in enumerate(grid)], "idx long, value struct<size:int,step:int,elements:array<double>>")
    got = [r.value for r in windows.flatten_windows(df).orderBy("idx").collect()]
    assert got == [0, 1, 5, 9, 6, 16, 18]


def test_resolver_gets_following_then_current(spark):
    got = values(ints(spark, 6).window(3, 2).flatten(lambda following, current: following * 10 - current), spark)
    assert got == [0, 1, 18, 3, 36, 5, 0]


def test_resampling_cases(spark):
    s = ints(spark, 5)
    s.rate = 1000.0
    assert values(s.resample(2000.0, method="simple"), spark, 2000.0) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert values(s.resample(500.0, F.sum, "simple"), spark, 500.0) == [1, 5, 4]
    twice = s.resample(500.0, F.sum, "simple").map(lambda v: v * 2).resample(250.0, F.sum, "simple")
    assert values(twice, spark, 250.0) == [12, 8]
    assert values(s.resample(1000.0), spark) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        values(s.resample(1500.0, method="simple"), spark, 1500.0)


def test_aligned_sinc_keeps_a_wave(spark):
    wave = Stream.sine(40.0).trim(1, "s")
    wave.rate = 8000.0
    got = np.array(values(wave.resample(16000.0, taps=64, align=True), spark, 16000.0))
    want = np.cos(2 * np.pi * 40 * np.arange(len(got)) / 16000)
    assert np.abs(got - want)[200:-200].max() < 0.02


def test_projection_and_trim(spark):
    assert values(ints(spark, 10).range_projection(1000), spark, 2.0) == [2, 3, 4, 5, 6, 7, 8, 9]
    assert values(ints(spark, 2).after_filling(7.0).trim(4), spark) == [0, 1, 7, 7]
    assert values(ints(spark, 2).concat(Stream.generate(lambda i, r: i.cast("double"))).trim(5), spark) == [0, 1, 0, 1, 2]
    with pytest.raises(ValueError):
        Stream.sine(1.0).build(spark)
    with pytest.raises(ValueError):
        Stream.sine(1.0).concat(ints(spark, 1))
    with pytest.raises(ValueError):
        Stream.from_list(spark, [])


def test_rates_are_checked(spark):
    a, b = ints(spark, 2), ints(spark, 2)
    a.rate, b.rate = 1000.0, 2000.0
    with pytest.raises(ValueError):
        a + b
    with pytest.raises(ValueError):
        sinks.to_dev_null(a, spark, 44100.0)


@FEW
@given(st.integers(1, 40), st.integers(2, 7), st.integers(1, 9))
def test_windows_by_brute_force(spark, n, size, step):
    x = [float(v) for v in range(n)]
    got = {r.idx: list(r.value.elements) for r in Stream.from_list(spark, x).window(size, step).build(spark).collect()}
    assert got == {w: x[w * step : w * step + size] for w in range(math.ceil(n / step))}


@FEW
@given(st.integers(1, 30), st.integers(2, 6), st.integers(1, 6))
def test_flatten_adds_overlaps(spark, n, size, step):
    got = values(Stream.from_list(spark, [1.0] * n).window(size, step).flatten(), spark)
    starts = range(0, n, step)
    want = [float(sum(s <= p < min(s + size, n) for s in starts)) for p in range(starts[-1] + max(size, step))]
    assert got == want


def test_zero_pad_and_transform(spark):
    assert spectral.zero_pad(np.array([1, 2, 3, 4, 5]), 8).tolist() == [3, 4, 5, 0, 0, 0, 1, 2]
    for m in range(1, 9):
        x = np.arange(1, m + 1)
        assert spectral.undo_pad(spectral.zero_pad(x, 8), m).tolist() == x.tolist()
    w = Stream.from_list(spark, [3.0, 4.0, 1.0, 2.0]).window(4)
    f = [(z.re, z.im) for z in w.fft(4, "standard").build(spark, 4.0).first().value.fft]
    assert np.allclose(f, [(10, 0), (-2, 2), (-2, 0), (-2, -2)])
    f = [(z.re, z.im) for z in w.fft(4).build(spark, 4.0).first().value.fft]
    assert np.allclose(f, [(10, 0), (-2, -2), (-2, 0), (-2, 2)])
    with pytest.raises(ValueError):
        w.fft(3).build(spark)


def test_spectrum_lines(spark):
    df = ints(spark, 4).window(2).fft(4).build(spark, 4.0)
    assert [r.line.split(",")[0] for r in sinks.spectrum_lines(df, spectral.magnitude).orderBy("idx").collect()] == ["0", "499"]
    assert sinks.spectrum_header(df) == "time ms \\ freq hz,0.00000,1.00000"


def test_time():
    assert TimeMeasure.parse("1.5s") == TimeMeasure(1000, "ms") and TimeMeasure.parse_or_none("x") is None
    assert (TimeMeasure(1, "s") + TimeMeasure(5, "ms")).ns == 1_005_000_000 and TimeMeasure(1999, "us").to("ms") == 1
    assert (index_floor(1_500_000, 1000), index_ceil(1_500_000, 1000), samples_to_time(3, 2.0)) == (1, 2, 1500)


@pytest.fixture
def ten_ranges(spark):
    """Ranges of about a tenth of the rows, however few these are."""
    names = {"spark.sql.shuffle.partitions": "10", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_dense_index_over_ranges(spark, ten_ranges):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 3).alias("z"))
    got = indexing.dense_index(df, ["k"]).collect()
    assert all(r.k == r.idx for r in got) and len(got) == 1000
    tied = indexing.dense_index(spark.range(600).selectExpr("id % 4 AS k", "id AS z"), ["k", "z"]).orderBy("idx").collect()
    assert [(r.k, r.z) for r in tied] == sorted((i % 4, i) for i in range(600)) and [r.idx for r in tied] == list(range(600))
    hot = spark.range(1000).selectExpr("'same' AS k", "cast(id % 500 AS string) AS s", "id AS z", "id AS _part")
    placed = indexing.dense_index(hot, ["k", "s", "z"]).orderBy("idx").collect()
    assert [(r.s, r.z) for r in placed] == sorted((str(i % 500), i) for i in range(1000)) and [r.idx for r in placed] == list(range(1000))
    # One value of the first column in all rows is many ranges, and the plan has no window over all of them.
    rows, part, place = indexing.ranged(hot, ["k", "s", "z"])
    assert rows.select(part).distinct().count() > 5 and rows.groupBy(part).agg(F.max(place).alias("m")).agg(F.max("m")).scalar() is not None
    nulls = spark.createDataFrame([(None, 1), (3, 2), (None, 0), (1, 3)], "k int, z int")
    assert [r.z for r in indexing.dense_index(nulls, ["k", "z"]).orderBy("idx").collect()] == [0, 1, 3, 2]
    assert indexing.dense_index(nulls.limit(0), ["k"]).count() == 0


def plan_size(df):
    return len(df._jdf.queryExecution().analyzed().toString())


def test_plan_of_positions_does_not_grow_with_rows(spark, ten_ranges):
    few, many = (indexing.dense_index(spark.range(n).withColumnRenamed("id", "k"), ["k"]) for n in (100, 200_000))
    assert abs(plan_size(few) - plan_size(many)) < 200
    assert many.where("idx <> k").count() == 0


def test_mixed_flatten_over_ranges(spark, ten_ranges):
    rng = np.random.default_rng(2)
    grid = [(int(size), int(step), rng.integers(0, 9, size).astype(float).tolist()) for size, step in zip(rng.integers(2, 6, 300), rng.integers(1, 6, 300), strict=True)]
    df = spark.createDataFrame(list(enumerate(grid)), "idx long, value struct<size:int,step:int,elements:array<double>>")
    want, at = {}, 0
    for size, step, e in grid:
        for k in range(max(size, step)):
            want[at + k] = want.get(at + k, 0.0) + (e[k] if k < size else 0.0)
        at += step
    assert {r.idx: r.value for r in windows.flatten_windows(df).collect()} == want


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_signals_without_keys_are_as_with_one(spark, ten_ranges, seed):
    rng = np.random.default_rng(seed)
    ending = managed.CLOSE_OUTPUT if seed else managed.NOOP
    kinds = rng.choice([managed.NOOP, managed.FLUSH, managed.OPEN_GATE, managed.CLOSE_GATE], 1000, p=[0.8, 0.1, 0.05, 0.05]).tolist()
    rows = [(i, int(k) if i != 700 else ending, 1) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "idx long, s int, one int")
    find = lambda keys: sorted((r.idx, r.file_no, r.suffix_argument) for r in managed.files(df, F.col("s"), F.col("idx"), keys).collect())
    plain = find(None)
    assert plain == find(["one"]) and len(plain) > 100
    # The state machine, one element after the other.
    is_open, some, number, argument, want = True, False, 0, None, []
    for i, k, _ in rows:
        was, is_open = is_open, k == managed.OPEN_GATE if k in (managed.OPEN_GATE, managed.CLOSE_GATE) else is_open
        if is_open:
            if (k == managed.FLUSH and some) or (k == managed.OPEN_GATE and not was):
                number, argument = number + 1, i
            some = True
            want.append((i, number, argument))
        if k == managed.CLOSE_OUTPUT:
            break
    assert plain == want


@pytest.mark.parametrize("bits", [8, 16, 24, 32, 64])
def test_pcm_round_trip(bits):
    x = np.array([0.0, 0.5, -0.5, 1.0, -1.0, 1e-3, -1e-3])
    assert np.abs(pcm.decode(pcm.encode(x, bits), bits) - x).max() <= 1.0 / samples.MAX[bits] + 1e-15
    assert pcm.encode(np.array([-1 / 0x7FFFFF]), 24) == b"\xff\xff\xff"


def test_wav_file(spark, tmp_path):
    path = str(tmp_path / "x.wav")
    assert pcm.write_wav(Stream.sine(10.0, 0.5).trim(100), spark, path, 1000.0) == 200
    got = values(pcm.wave(spark, path, resample=False), spark)
    assert np.allclose(got, 0.5 * np.cos(2 * np.pi * 10 * np.arange(100) / 1000), atol=4e-5)
    with pytest.raises(ValueError):
        pcm.read_header(b"x" * 44)


def test_csv_and_function_sinks(spark, tmp_path):
    sinks.to_csv(ints(spark, 3), spark, str(tmp_path / "c"), 1000.0)
    lines = [x for f in sorted((tmp_path / "c").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["time ms,value", "0,0.0000000000", "1,1.0000000000", "2,2.0000000000"]
    seen = []
    sinks.to_function(ints(spark, 5), spark, lambda *a: seen.append(a) or a[1] < 2, 1000.0)
    assert [a[0] for a in seen] == ["write", "write", "write", "close"]


def test_managed_files_keep_the_order(spark, tmp_path, ten_ranges):
    df = spark.range(3000).select(((F.col("id") * 1009) % 3000).alias("idx")).withColumn("value", F.col("idx") / 4096)
    signals = F.when(F.col("idx").isin(700, 2500), managed.FLUSH).when(F.col("idx") == 1000, managed.CLOSE_GATE).when(F.col("idx") == 1500, managed.OPEN_GATE).otherwise(managed.NOOP)
    files = sinks.managed_csv(df, signals, F.col("idx"), str(tmp_path / "csv"), "head", lambda v: (v * 4096).cast("long").cast("string")).collect()
    want = {"00000000": range(700), "00000001700": range(700, 1000), "000000021500": range(1500, 2500), "000000032500": range(2500, 3000)}
    for name, numbers in want.items():
        lines = [x for f in sorted((tmp_path / "csv" / f"name={name}").glob("part-*")) for x in f.read_text().splitlines()]
        assert lines == ["head", *map(str, numbers)]
    assert {r.name: r.n_lines for r in files} == {n: len(k) for n, k in want.items()} and max(r.n_parts for r in files) > 1
    found = sinks.managed_wav(df, signals, F.col("idx"), f"file://{tmp_path}/wav", 1000.0).collect()
    assert {r.name: r.n_samples for r in found} == {f"{n}.wav": len(k) for n, k in want.items()}
    got = values(pcm.wave(spark, str(tmp_path / "wav" / "000000021500.wav"), resample=False), spark)
    assert np.allclose(got, np.arange(1500, 2500) / 4096, atol=4e-5)


def test_tables(spark, tmp_path):
    registry = tables.Registry()
    t = registry.register(tables.TimeTable(spark, "t", str(tmp_path / "t"), 1000.0))
    assert t.last_marker() is None
    t.write(ints(spark, 1000))
    ms = lambda n: TimeMeasure(n, "ms")
    assert sorted(r.value for r in t.last(ms(100)).collect()) == list(range(900, 1000))
    assert sorted(r.value for r in t.time_range(ms(800), ms(900)).collect()) == list(range(800, 900))
    assert t.time_range(ms(1000), ms(1100)).count() == 0
    assert (t.first_marker(), t.last_marker()) == (0, 999_000_000)
    assert values(t.stream().trim(3), spark) == [0, 1, 2]
    with pytest.raises(ValueError):
        t.write(ints(spark, 1))
    with pytest.raises(ValueError):
        registry.register(t)
    with pytest.raises(KeyError):
        registry.by_name("other")
    t.finished = False
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(5, 1.0)], "marker_ns long, value double"))
    t.retention = ms(10)
    assert t.rows().count() == 10


def test_continuous_reading(spark, tmp_path):
    t = tables.TimeTable(spark, "live", str(tmp_path / "live"), 1000.0)
    t.append(spark.createDataFrame([(i, float(i)) for i in range(10)], "marker_ns long, value double"))
    q = t.follow(TimeMeasure(3, "ns")).writeStream.format("memory").queryName("live_rows").start()
    try:
        q.processAllAvailable()
        t.append(spark.createDataFrame([(20, 20.0)], "marker_ns long, value double"))
        q.processAllAvailable()
        assert sorted(r.value for r in spark.table("live_rows").collect()) == [6, 7, 8, 9, 20]
    finally:
        q.stop()


def test_signals(spark):
    n, f, o, c, e = managed.NOOP, managed.FLUSH, managed.OPEN_GATE, managed.CLOSE_GATE, managed.CLOSE_OUTPUT
    rows = [(0, f, 1), (1, n, None), (2, f, 2), (3, c, 3), (4, n, None), (5, o, 4), (6, o, 5), (7, e, 6), (8, n, None)]
    df = spark.createDataFrame(rows, "idx long, s int, a int")
    got = [(r.idx, r.file_no, r.suffix_argument) for r in managed.files(df, F.col("s"), F.col("a")).orderBy("idx").collect()]
    assert got == [(0, 0, None), (1, 0, None), (2, 1, 2), (5, 2, 4), (6, 2, 4), (7, 2, 4)]


def test_division_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 2.0), (3.0, None)], "x double, y double")
    got = [r[0] for r in df.select(samples.combine(F.col("x"), F.col("y"), "/")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [0.25, 0.0, 0.0]
