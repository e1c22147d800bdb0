"""Archives are read back as they were written; broken ones raise."""

import hashlib
import io

import pytest

from streamloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest int"


def make(i, payload, refers=None):
    return warc.record(i, f"http://h/{i} \r\n", payload, hashlib.sha256(payload).hexdigest(), refers)


def test_round_trip(spark):
    long = "é" * 300_000 + "x" * 70_000
    rows = [(3, "u", "a" * 100), (1, None, "a" * 100), (2, "u", "a" * 99), (5, "u", "a" * 99), (7, "u", None), (8, "u", ""), (9, "u é", long), (10, "u", long), (None, "u", long), (1, "u", "a" * 100), (11, "u", "\r\n\r\n" * 40)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    manifest = warc.write_archives(df)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect())

    def want(i, text):
        body = (text or "").encode()
        same = [j for j, _, t in rows if t == text and j is not None]
        refers = min(same) if len(body) >= 100 and min(same) != i else None
        return i or 0, len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers is not None else "response", refers

    assert got == sorted(want(i, t) for i, _, t in rows)


def test_small_archives_roll(spark):
    df = spark.createDataFrame([(i, "u", f"page {i}", 0) for i in range(20)], SCHEMA).coalesce(1)
    manifest = warc.write_archives(df, max_archive_bytes=1000)
    assert manifest.count() > 3
    assert warc.read_archives(manifest).count() == 20
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_reader_keeps_payloads_of_many_members():
    bodies = [b"", b"x", bytes(range(256)) * 5000]
    found = list(warc.read_records(io.BytesIO(b"".join(make(i, b) for i, b in enumerate(bodies))), keep_payload=True))
    assert [r["payload"] for r in found] == bodies


def test_broken_archives_raise():
    whole = make(1, b"hello" * 1000)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(whole[:-20])))
    wrong = warc.record(1, "u", b"hello", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(wrong)))


def test_ids_of_other_types(spark):
    body = "b" * 200
    rows = [("p/2 é", "u", body), ("p/10>", "u", body), (None, "u", "x"), ("", "u", body + "c")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df), "string").collect()}
    assert got == {("p/2 é", "revisit", "p/10>"), ("p/10>", "response", None), (None, "response", None), ("", "response", None)}
    number = spark.createDataFrame([(1.5, "u", body)], "page_id double, url string, html string")
    assert warc.read_archives(warc.write_archives(number), "double").first().page_id == 1.5
