"""Functions in Python over streams, generators that end, transforms of any length."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from streamloom.functions import time as tm
from streamloom.operators import sequences
from streamloom.plans.stream import Stream
from streamloom.sources import pcm


@pytest.fixture(scope="module")
def signal():
    return np.random.default_rng(3).normal(0, 1, 5000)


def stream(spark, x):
    return Stream.from_indexed(spark.createDataFrame(pa.table({"idx": np.arange(len(x)), "value": x})))


def values(s, spark):
    return np.array(list(s.collect(spark, 1000.0)))


def test_python_functions_over_elements(spark, signal):
    s = stream(spark, signal)
    assert np.allclose(values(s.map_batches(lambda v: np.vectorize(math.erf)(v.to_numpy())), spark), [math.erf(x) for x in signal])
    assert values(s.map_batches(lambda v: pc.greater(v, 0), "boolean"), spark).tolist() == (signal > 0).tolist()
    words = s.map_batches(lambda v: [None if x < 0 else f"{x:.1f}" for x in v.to_pylist()], "string")
    assert list(words.collect(spark, 1000.0)) == [None if x < 0 else f"{x:.1f}" for x in signal]
    with pytest.raises(Exception, match="values for"):
        values(s.map_batches(lambda v: v[:1]), spark)


def test_python_functions_that_give_lists(spark):
    s = stream(spark, np.arange(2000.0))
    got = values(s.flat_map_batches(lambda v: [None if x % 7 == 0 else [x] * int(x % 4) for x in v.to_pylist()]), spark)
    assert got.tolist() == [x for x in map(float, range(2000)) if x % 7 for _ in range(int(x % 4))]
    assert values(s.flat_map_batches(lambda v: [[x, -x] for x in v.to_pylist()]).trim(5), spark).tolist() == [0, 0, 1, -1, 2]
    nothing = stream(spark, np.zeros(0))
    assert len(values(nothing.map_batches(lambda v: v), spark)) == len(values(nothing.flat_map_batches(lambda v: [[x] for x in v]), spark)) == 0


@pytest.mark.parametrize("block", [64, 4999, 5000, 1 << 18])
def test_finite_reach_equals_one_pass(spark, signal, block):
    taps = np.array([0.5, -0.25, 0.125, 1.0, 2.0])

    def fir(x, here, start):
        padded = np.concatenate([np.zeros(max(0, 4 - here.start)), x[max(0, here.start - 4) : here.stop]])
        return np.convolve(padded, taps, "valid")

    got = values(stream(spark, signal).sequence(fir, before=4, block=block), spark)
    assert np.allclose(got, np.convolve(signal, taps)[: len(signal)])


def test_sequences_of_another_rate(spark, signal):
    """Two for three, by linear interpolation, which looks one sample ahead."""

    def interpolate(x, here, start):
        first, last = -(-start * 2 // 3), -(-(start + here.stop - here.start) * 2 // 3)
        return np.interp(np.arange(first, last) * 1.5, np.arange(start - here.start, start - here.start + len(x)), x)

    s = stream(spark, signal)
    s.rate = 1500.0
    got = s.sequence(interpolate, before=1, after=1, rate=1000.0, block=100)
    assert got.rate == 1000.0
    want = np.interp(np.arange(-(-5000 * 2 // 3)) * 1.5, np.arange(5000), signal)
    assert np.allclose(values(got, spark), want)


@pytest.mark.parametrize("block", [37, 1 << 18])
def test_filter_with_memory_equals_one_pass(spark, signal, block):
    a = 0.97

    def iir(x, state):
        out = []
        for v in x:
            state = v + a * state
            out.append(state)
        return out, state

    summary = lambda x: (a ** len(x), iir(x, 0.0)[1])
    got = stream(spark, signal).scan(iir, 5.0, summary, lambda state, s: s[0] * state + s[1], block)
    assert np.allclose(values(got, spark), iir(signal, 5.0)[0])
    with pytest.raises(Exception, match="values for"):
        sequences.scan(stream(spark, signal).build(spark), lambda x, s: (x[1:], s), 0, lambda x: 0, lambda s, t: s).collect()


def test_generators_end_at_their_first_null(spark):
    for n in (0, 1, 70_000, 300_000):
        s = Stream.generate(lambda i, rate, n=n: F.when((i < n) | (i > n + 5), i * 2.0), ends_at_null=True)
        df = s.build(spark, 10.0)
        assert s.finite and (df.count(), df.agg(F.max("idx")).first()[0]) == (n, n - 1 if n else None)
        assert s.trim(100, "s").build(spark, 10.0).count() == min(n, 1000)
    with pytest.raises(ValueError):
        Stream.generate(lambda i, rate: i * 1.0).build(spark)


@pytest.mark.parametrize("size", [2, 13, 64, 1009])
def test_transforms_of_any_length(spark, signal, size):
    x = signal[: 3 * size + 1]
    w = stream(spark, x).window(size)
    got = {r.idx: np.array([c.re + 1j * c.im for c in r.value]) for r in w.dft().build(spark).collect()}
    assert len(got) == 4 and all(np.allclose(got[k], np.fft.fft(x[k * size : (k + 1) * size])) for k in got)
    back = {r.idx: [(c.re, c.im) for c in r.value] for r in w.dft().dft(inverse=True).build(spark).collect()}
    assert all(np.allclose(np.array(back[k]).T, [x[k * size : (k + 1) * size], np.zeros(len(back[k]))]) for k in back)


def test_blocks_of_bytes_and_lengths_of_time(spark):
    data = [bytes([1, 2, 3]), None, b"", bytes(range(256))]
    df = spark.createDataFrame(list(enumerate(data)), "n long, b binary")
    got = values(pcm.pcm_blocks(df, ["n"], "b", 1000.0, 8), spark)
    assert np.allclose(got, pcm.decode(data[0] + data[3], 8))
    texts = ["5s", " 7 MS ", "1.9h", "-3us", "2d", "x", "", "5", "5 s s", None, "12ns", "4m"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tm.parse_ns(F.col("t"))).collect()]
    assert found == [None if t is None or (m := tm.TimeMeasure.parse_or_none(t)) is None else m.ns for t in texts]
    n = spark.range(0, 100_000, 37)
    for rate in (44100.0, 43210.1, 8000.0):
        rows = n.select("id", tm.time_of(F.col("id"), rate, "us"), tm.floor_of(F.col("id") * 1000, rate), tm.ceil_of(F.col("id") * 1000, rate)).collect()
        assert all((a, b, c) == (tm.samples_to_time(i, rate, "us"), tm.index_floor(i * 1000, rate), tm.index_ceil(i * 1000, rate)) for i, a, b, c in rows)
