"""WARC archives: a writer, and a sequential reader of one gzip member per record.

Writer: equal payloads of at least `revisit_from` bytes become one response, that of the smallest page_id, and
revisits that refer to it. Each task writes its own archive files under names that no other attempt uses; the manifest
that the job returns lists the files of the attempts that Spark committed, so lost executors leave no doubled records.
Reader: tasks take archives from the manifest, decompress them piece by piece, frame records by Content-Length and
check block and payload digests; a broken archive raises.

Files are opened with pyarrow's file systems, so the shared folder may be a local path, s3, gs or hdfs.

Defined results: a null html is an empty payload; all rows that carry the smallest page_id of a group are responses;
a null page_id is never a response that others refer to, it comes back as null; a null url is written as an empty
target; ids of any type are written as text, quoted, and read back as the type that is asked for; an empty table gives an empty
manifest and no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import fresh_path, likely, materialize

CHUNK = 1 << 16
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record(page_id: str | int | None, url: str, payload: bytes, digest: str, refers_to: str | int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{quote(str(refers_to), safe='')}>"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source, rest: bytes):
        self.source, self.z, self.ready = source, zlib.decompressobj(31), b""
        self._feed(rest)

    def _feed(self, data: bytes) -> None:
        self.ready += self.z.decompress(data, CHUNK)

    def more(self) -> bool:
        if self.z.eof:
            return False
        if self.z.unconsumed_tail:
            self._feed(self.z.unconsumed_tail)
        else:
            data, before = self.source.read(CHUNK), len(self.ready)
            self._feed(data)
            if not data and len(self.ready) == before and not self.z.eof:
                raise ValueError("archive ends inside a gzip member")
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not self.more():
                raise ValueError("record without an end of its head")
        head, self.ready = self.ready.split(mark, 1)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise ValueError("record shorter than its Content-Length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def read_records(source, keep_payload: bool = False) -> Iterator[dict]:
    """Each record of an open archive, in order: its fields (`warc`, `http`), payload_bytes, and `payload` if it is to be kept.
    Raises ValueError where framing or a digest is wrong."""
    rest = b""
    while True:
        rest = rest or source.read(CHUNK)
        if not rest:
            return
        member = _Member(source, rest)
        warc = _fields(member.until(b"\r\n\r\n"))
        block, payload = hashlib.sha256(), hashlib.sha256()
        http: dict[str, str] | None = None
        early, kept, size = b"", [], 0
        for part in member.take(int(warc["content-length"])):
            block.update(part)
            if http is None:
                early += part
                if b"\r\n\r\n" not in early:
                    continue
                head, part = early.split(b"\r\n\r\n", 1)
                http = _fields(head)
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        if b"".join(member.take(4)) != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")
        while member.more():
            pass
        if member.ready:
            raise ValueError("more than one record in a gzip member")
        rest = member.z.unused_data
        if warc["warc-block-digest"] != f"sha256:{block.hexdigest()}":
            raise ValueError(f"block digest of {warc['warc-record-id']} is wrong")
        if warc["warc-type"] == "response" and warc["warc-payload-digest"] != f"sha256:{payload.hexdigest()}":
            raise ValueError(f"payload digest of {warc['warc-record-id']} is wrong")
        yield {"warc": warc, "http": http or {}, "payload_bytes": size} | ({"payload": b"".join(kept)} if keep_payload else {})


def _page(name: str | None) -> str | None:
    return unquote(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 100, max_archive_bytes: int = 1 << 30) -> DataFrame:
    """Write all pages as WARC files in the shared folder. Returns the manifest: path, n_records, n_bytes. Of payloads only those are shuffled
    whose digest may come more than once."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = materialize(
        rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n"),
        "warc-firsts",
    )
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(None)).otherwise(F.col("first_id")).cast("string")
    named = [F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest"]
    shared, lone = likely(rows, F.col("digest"), firsts.select("digest"))
    ready = lone.select(*named, F.lit(None).cast("string").alias("refers_to")).unionByName(shared.join(firsts, "digest", "left").select(*named, refers.alias("refers_to")))
    folder = fresh_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        out, path, n, size, done = None, "", 0, 0, []
        store.create_dir(root, recursive=True)
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                data = record(page_id, url, payload, digest, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= max_archive_bytes:
                    out.close()
                    done.append((f"{folder}/{path}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", n, size))
        yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in done], t) for i, (k, t) in enumerate((("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())))})

    return materialize(ready.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """One row for each record of the manifest's archives, in tasks of one archive or a few; ids as id_type."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _open(path)
                rows: list[tuple] = []
                with store.open_input_stream(name, compression=None) as source:
                    for r in read_records(source):
                        w = r["warc"]
                        rows.append((_page(w["warc-record-id"]), w["warc-target-uri"], int(r["http"]["content-length"]), w["warc-payload-digest"].removeprefix("sha256:"), w["warc-type"], _page(w.get("warc-refers-to"))))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()))
        return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)})

    n = max(1, manifest.count())
    found = manifest.select("path").repartition(n, "path").mapInArrow(read, RECORDS)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
