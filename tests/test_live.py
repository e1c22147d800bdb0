"""Managed outputs of running streams equal those of whole tables, also after restarts."""

import random

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from streamloom.sources import pcm, sinks
from streamloom.streaming import live, managed

KIND = "idx long, k string, s int, a long, value double"


def events(seed, n=400):
    rng = random.Random(seed)
    big = 2**60 + 1
    return [(i, rng.choice(["x", "y", "z", None]), rng.choice([0] * 8 + [1, 1, 2, 3, 3]), rng.choice([None, big + i]), i / 512) for i in range(n)]


def feed(spark, path, rows, cuts):
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = rows[lo:hi]
        random.Random(lo).shuffle(part)
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)


def test_steps_equal_the_whole(spark):
    rng = random.Random(1)
    for trial in range(200):
        n = rng.randrange(0, 30)
        signal = np.array([rng.choice([0, 0, 0, 1, 2, 3, 4 if trial % 3 == 0 else 0]) for _ in range(n)], np.int64)
        args = np.array([rng.choice([None, i]) for i in range(n)], object)
        whole = managed.step(signal, args, managed.State())
        state, pieces, at = managed.State(), [], 0
        while at < n:
            to = at + rng.randrange(1, 6)
            *piece, state = managed.step(signal[at:to], args[at:to], state)
            pieces.append(piece)
            at = to
        for k in range(4):
            w = whole[0]
            assert np.concatenate([p[k] for p in pieces] or [w])[w].tolist() == whole[k][w].tolist()
        assert state == whole[4]


@pytest.mark.parametrize("cuts", [[0, 400], [0, 1, 150, 151, 300, 400]])
def test_keyed_stream_with_a_restart(spark, tmp_path, cuts):
    rows, path = events(2), str(tmp_path / "in")

    def run():
        found = live.files(source(spark, path), ["k"], ["idx"], F.col("s"), F.col("a"))
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()

    feed(spark, path, rows, cuts[:3])
    run()
    feed(spark, path, rows, cuts[2:])
    run()
    whole = managed.files(spark.createDataFrame(rows, KIND), F.col("s"), F.col("a"), ["k"])
    columns = ["idx", "k", "s", "a", "value", "file_no", "suffix_argument"]
    want = sorted((tuple(r) for r in whole.select(*columns).collect()), key=repr)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want
    firsts = sorted((r.k or "", r.file_no, r.idx) for r in got.where("begins").collect())
    assert firsts == sorted((k or "", no, i) for (k, no), i in {(w[1], w[5]): min(x[0] for x in want if (x[1], x[5]) == (w[1], w[5])) for w in want}.items())


def test_late_elements(spark, tmp_path):
    rows = [(i, "x", 0, None, 0.0) for i in (5, 6, 3, 7)]
    feed(spark, str(tmp_path / "in"), rows, [0, 2, 4])

    def run(late):
        query = live.files(source(spark, str(tmp_path / "in")), ["k"], ["idx"], F.col("s"), F.col("a"), late).writeStream.format("memory").queryName(f"late_{late}").option("checkpointLocation", str(tmp_path / late)).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(StreamingQueryException, match="older"):
        run("raise")
    run("drop")
    assert sorted(r.idx for r in spark.table("late_drop").collect()) == [5, 6, 7]


def lines(spark, path):
    """Files by name, as their parts come one after the other."""
    found = spark.read.schema("value string, batch string, name string").text(path).withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id()).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.batch, r.f, r.i)):
        out.setdefault(r.name, []).append(r.value)
    return out


def test_single_stream_to_csv_and_wav_with_a_lost_note(spark, tmp_path):
    rows, path = events(3), str(tmp_path / "in")
    rows = [(i, k, s, a and a % 1000, v) for i, k, s, a, v in rows]
    suffix = F.concat(F.lit("-"), F.col("suffix_argument").cast("string"))
    line = F.concat_ws(",", "idx", "value")
    csv, wav = str(tmp_path / "csv"), f"file://{tmp_path}/wav"

    def run():
        for name, out, write in (("c1", csv, live.csv_of("head", line, suffix)), ("c2", wav, live.wav_of(1000.0, 16, suffix))):
            live.single(source(spark, path), ["idx"], F.col("s"), F.col("a"), out, str(tmp_path / name), write).awaitTermination()

    feed(spark, path, rows, [0, 90, 91, 200])
    run()
    for name in ("c1", "c2"):
        (tmp_path / name / "commits/2").unlink()
        (tmp_path / name / "commits/.2.crc").unlink(missing_ok=True)
    feed(spark, path, rows, [200, 333, 400])
    run()
    df = spark.createDataFrame(rows, KIND)
    found = managed.files(df, F.col("s"), F.col("a")).withColumn("name", sinks.names(suffix)).orderBy("idx").collect()
    want = {}
    for r in found:
        want.setdefault(r.name, ["head"]).append(f"{r.idx},{r.value}")
    assert lines(spark, csv) == want and len(want) > 10
    name = max(want, key=lambda n: len(want[n]))
    batches = sorted((tmp_path / "wav").glob("batch=*"))
    got = np.concatenate([[r.value for r in pcm.wave(spark, str(b / f"{name}.wav"), resample=False).build(spark, 1000.0).orderBy("idx").collect()] for b in batches if (b / f"{name}.wav").exists()])
    assert np.allclose(got, [r.value for r in found if r.name == name], atol=4e-5)


def test_keyed_sinks(spark, tmp_path):
    rows = [(i, "xy"[i % 2], 1 if i in (4, 5, 12) else 0, i, i / 64) for i in range(20)]
    feed(spark, str(tmp_path / "in"), rows, [0, 7, 20])
    found = live.files(source(spark, str(tmp_path / "in")), ["k"], ["idx"], F.col("s"), F.col("a"))
    live.to_csv(found, ["idx"], str(tmp_path / "csv"), str(tmp_path / "c1"), "h", F.col("idx").cast("string"), F.concat("k", F.lit("-"))).awaitTermination()
    files = {"x-00000000": [0, 2], "x-000000014": [4, 6, 8, 10], "x-0000000212": [12, 14, 16, 18], "y-00000000": [1, 3], "y-000000015": [5, 7, 9, 11, 13, 15, 17, 19]}
    assert lines(spark, str(tmp_path / "csv")) == {n: ["h", *map(str, x)] for n, x in files.items()}
    live.to_wav(found, ["idx"], f"file://{tmp_path}/wav", str(tmp_path / "c2"), 1000.0, 16, "value", F.concat("k", F.lit("-"))).awaitTermination()
    for n, x in files.items():
        got = [r.value for b in sorted((tmp_path / "wav").glob("batch=*")) if (b / f"{n}.wav").exists() for r in pcm.wave(spark, str(b / f"{n}.wav"), resample=False).build(spark, 1000.0).orderBy("idx").collect()]
        assert np.allclose(got, np.array(x) / 64, atol=4e-5)


def test_hot_keys_by_ranges(spark, monkeypatch):
    rows = events(7, 600)
    # Half of all rows have one key, the null key is hot too; ranges cut through them.
    df = spark.createDataFrame([(i, "x" if i % 2 else k, s, a, v) for i, k, s, a, v in rows], KIND)
    want = sorted(map(repr, managed.files(df, F.col("s"), F.col("a"), ["k"]).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(managed, "HOT", 50)
        assert sorted(map(repr, managed.files(df, F.col("s"), F.col("a"), ["k"]).collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
