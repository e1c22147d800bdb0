"""WAV files read by ranges of bytes, and written by tasks as one file."""

import struct

import numpy as np
import pytest

from streamloom.plans.stream import Stream
from streamloom.sources import files, pcm


def values(df):
    return [r["value"] for r in df.orderBy("idx").collect()]


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def signal(spark, n, bits=16):
    return Stream.from_indexed(spark.range(n).selectExpr("id as idx", f"(id % 251 - 125) / {pcm.MAX[bits]}.0D as value"))


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_one_file_by_many_tasks_and_back_by_many(many_ranges, tmp_path, bits):
    spark, path = many_ranges, str(tmp_path / "one.wav")
    width = bits // 8
    assert pcm.write_wav(signal(spark, 10_001, bits), spark, path, 8000.0, bits) == 10_001 * width
    raw = (tmp_path / "one.wav").read_bytes()
    whole = np.arange(10_001) % 251 - 125
    assert raw[:44] == pcm.wav_header(10_001 * width, 8000.0, bits) and raw[44:] == pcm.encode(whole / pcm.MAX[bits], bits)
    df = pcm.wav_files(spark, path, range_bytes=1000)
    assert df.rdd.getNumPartitions() == -(-10_001 // (1000 // width))
    assert np.allclose(values(df), whole / pcm.MAX[bits])
    stream = pcm.wave(spark, path, resample=False, range_bytes=1000)
    assert stream.rate == 8000.0 and np.allclose(values(stream.trim(7, "ms").build(spark)), whole[:56] / pcm.MAX[bits])
    assert len(pcm.pieces(f"file://{path}", 1000, until=56)) == -(-56 * width // 1000)


def test_parts_and_folders(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    rows = spark.range(300).selectExpr("id div 3 as idx", "id / 512 as value", "concat('n', id % 3) as name")
    pcm.write_wav_parts(rows, root, 100.0, 16, names="name", part_samples=40)
    found = pcm.wav_files(spark, root, range_bytes=33)
    got = {}
    for r in found.orderBy("name", "idx").collect():
        got.setdefault(r.name, []).append((r.idx, r.value))
    for k in range(3):
        assert [i for i, _ in got[f"n{k}"]] == list(range(100))
        assert np.allclose([v for _, v in got[f"n{k}"]], (np.arange(100) * 3 + k) / 512, atol=4e-5)
    assert len(values(pcm.wave(spark, f"{tmp_path}/w/n1", resample=False).build(spark))) == 100
    padded = pcm.wave(spark, f"{tmp_path}/w/n1", resample=False, converter=lambda s: s.after_filling(-1.0)).trim(2, "s").build(spark)
    assert values(padded)[100:] == [-1.0] * 100


def test_sizes_beyond_32_bits():
    n = 5 * 10**9
    data = pcm.wav_header(n, 44100.0, 16)
    assert len(data) == pcm.LONG_HEADER and data[:4] == b"RF64" and pcm.header_of(data) == (44100, 16, n, pcm.LONG_HEADER)
    assert struct.unpack("<Q", data[28:36])[0] == n
    most = 0xFFFFFFFF - 36
    assert pcm.header_of(pcm.wav_header(most, 8.0, 8)) == (8, 8, most, 44)


def test_long_header_in_a_file(spark, tmp_path, monkeypatch):
    body = pcm.encode(np.arange(50) / 64, 16)
    with monkeypatch.context() as m:
        m.setattr(pcm, "HEADER", 0xFFFFFFFF)
        head = pcm.wav_header(len(body), 10.0, 16)
    (tmp_path / "long.wav").write_bytes(head + body)
    assert len(head) == pcm.LONG_HEADER and np.allclose(values(pcm.wav_files(spark, str(tmp_path / "long.wav"), 32)), np.arange(50) / 64, atol=4e-5)


def test_what_fails_leaves_nothing(spark, tmp_path):
    gaps = Stream.from_indexed(spark.range(10).selectExpr("id * 2 as idx", "0.0D as value"))
    with pytest.raises(ValueError, match="dense"):
        pcm.write_wav(gaps, spark, str(tmp_path / "gaps.wav"))
    assert not (tmp_path / "gaps.wav").exists()
    with pytest.raises(FileNotFoundError):
        pcm.wave(spark, str(tmp_path / "none.wav"))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    with pytest.raises(ValueError):
        pcm.wave(spark, str(tmp_path / "bad.wav"))
    empty = Stream.from_indexed(spark.createDataFrame([], "idx long, value double"))
    assert pcm.write_wav(empty, spark, str(tmp_path / "empty.wav")) == 0 and (tmp_path / "empty.wav").read_bytes() == pcm.wav_header(0, 44100.0, 16)
    assert pcm.wav_files(spark, str(tmp_path / "empty.wav")).count() == 0


def test_vectors_and_a_file_in_the_way(spark, tmp_path):
    path = tmp_path / "v.wav"
    path.write_bytes(b"old")
    assert pcm.write_wav(signal(spark, 100).vectors(7), spark, str(path), 100.0) == 200
    assert np.allclose(values(pcm.wav_files(spark, str(path))), (np.arange(100) % 251 - 125) / 32767, atol=1e-9)
    assert [n for n in files.names(spark, str(tmp_path)) if n.endswith(".wav")] == ["v.wav"]


def test_function_sink_in_tasks(many_ranges, tmp_path):
    from streamloom.sources import sinks

    def make(first):
        said = []

        def fn(phase, at, value):
            said.append((phase, at))
            if phase == "close":
                (tmp_path / f"{first:06d}").write_text(repr(said))
            return not (phase == "write" and value == 3.0)

        return fn

    s = Stream.from_indexed(many_ranges.range(100).selectExpr("id as idx", "cast(id % 50 as double) as value"))
    found = sinks.to_function_in_tasks(s, many_ranges, make)
    assert len(found) > 2 and found[0][0] == 0 and found[0][1:] == (3, False) and [f for f, _, _ in found] == sorted(f for f, _, _ in found)
    first = eval((tmp_path / "000000").read_text())
    assert first == [*(("write", i) for i in range(4)), ("close", 4)]
    whole = [f for f, n, ended in found if ended and n]
    last = eval((tmp_path / f"{whole[-1]:06d}").read_text())
    assert last[-2:] == [("end", last[-3][1] + 1), ("close", last[-3][1] + 1)]


@pytest.mark.parametrize("bits", [8, 16, 24, 32, 64])
def test_parts_that_hold_what_is_beyond_their_bits(spark, tmp_path, bits):
    x = [(i % 97 - 48) / 32 if i % 5 else 0.25 for i in range(501)]
    x[7], x[8], x[300] = float("inf"), float("nan"), -1e300
    df = spark.createDataFrame(list(enumerate(x)), "idx long, value double")
    for whole in (True, False):
        pcm.write_wav_parts(df, f"file://{tmp_path}/{whole}", 100.0, bits, part_samples=167, whole=whole)
        data = (tmp_path / f"{whole}" / "part-00000001.wav").read_bytes()
        n = 167 * bits // 8
        assert data[44 : 44 + n] == pcm.encode(np.array(x[167:334]), bits) and struct.unpack("<I", data[4:8])[0] == len(data) - 8
        assert whole or len(data) == 44 + n
        got = np.array(values(pcm.wav_files(spark, f"{tmp_path}/{whole}", range_bytes=100)))
        held = np.array([abs(v) <= 1 for v in x])
        want = np.rint(np.array(x) * pcm.MAX[bits]) / pcm.MAX[bits]
        assert np.array_equal(got[held], want[held]) and np.array_equal(got[~held], want[~held], equal_nan=True) == whole


@pytest.mark.parametrize("bits", [8, 16, 24])
def test_one_file_that_holds_what_is_beyond_its_bits(many_ranges, tmp_path, bits):
    # An odd number of samples, so that the chunk after data of 8 or 24 bits is padded; a third of the samples are beyond.
    spark, path, n = many_ranges, str(tmp_path / "one.wav"), 10_001
    loud = Stream.from_indexed(spark.range(n).selectExpr("id as idx", f"(id % 251 - 125) / IF(id % 3 = 0, 2.0D, {pcm.MAX[bits]}.0D) as value"))
    k = np.arange(n) % 251 - 125
    want = np.rint(np.where(np.arange(n) % 3 == 0, k / 2, k / pcm.MAX[bits]) * pcm.MAX[bits]) / pcm.MAX[bits]
    assert pcm.write_wav(loud, spark, path, 8000.0, bits, whole=True) == n * bits // 8
    raw, n_beyond = (tmp_path / "one.wav").read_bytes(), int((np.abs(want) > 1 + 1.5 / pcm.MAX[bits]).sum())
    assert raw[44 : 44 + n * bits // 8] == pcm.encode(want, bits) and struct.unpack("<I", raw[4:8])[0] == len(raw) - 8
    assert len(raw) == 44 + n * bits // 8 + n * bits // 8 % 2 + 8 + 16 * n_beyond
    assert values(pcm.wav_files(spark, path, range_bytes=1000)) == want.tolist()
    first = pcm.wave(spark, path, resample=False, range_bytes=1000).trim(25, "ms").build(spark)
    assert values(first) == want[:200].tolist() and pcm.read_header(raw) == (8000, bits, n * bits // 8)


def test_sizes_with_a_chunk_after_the_data():
    n, records = 0xFFFFFFFF - 100, 20
    data = pcm.wav_header(n, 8.0, 8, 1, records)
    assert data[:4] == b"RF64" and pcm.header_of(data) == (8, 8, n, pcm.LONG_HEADER)
    assert struct.unpack("<Q", data[20:28])[0] == pcm.LONG_HEADER - 8 + n + 1 + 8 + 16 * records
