"""Small files and whole-file operations through Hadoop's file systems, for what a driver does once: logs, names, joins of parts.
Paths are any that Hadoop opens; tasks open qualified ones with pyarrow."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the session's default file system if it has none, so that tasks open what Spark opens."""
    store, place = _of(spark, path)
    return store.makeQualified(place).toString()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in their order; none if there is no such folder."""
    store, place = _of(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def read(spark: SparkSession, path: str) -> str:
    store, place = _of(spark, path)
    source = store.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write(spark: SparkSession, path: str, text: str | bytes) -> None:
    """A file in the place of one that may be there."""
    store, place = _of(spark, path)
    out = store.create(place, True)
    try:
        out.write(bytearray(text.encode() if isinstance(text, str) else text))
    finally:
        out.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """A file that must not be there yet, whole or not at all; False if it is."""
    jvm = spark.sparkContext._jvm
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    write(spark, draft, text)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(qualified(spark, folder)), spark.sparkContext._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(path), kinds)
        return True
    except Py4JJavaError as e:
        delete(spark, draft)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def delete(spark: SparkSession, path: str) -> None:
    store, place = _of(spark, path)
    store.delete(place, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file to the place of one that may be there."""
    store, place = _of(spark, target)
    if store.exists(place):
        store.delete(place, True)
    if not store.rename(_of(spark, source)[1], place):
        raise OSError(f"{source} can't be moved to {target}")


def concat(spark: SparkSession, target: str, parts: list[str]) -> None:
    """One file out of parts in order, which are gone then, by the file system's own concatenation: on HDFS blocks change owners, and nothing
    is copied. Stores that have none, as those of objects, get a copy through the driver, a buffer at a time."""
    jvm = spark.sparkContext._jvm
    store, place = _of(spark, target)
    paths = [_of(spark, p)[1] for p in parts]
    store.delete(place, True)
    local = store.getScheme() == "file"
    if not local:
        rename(spark, parts[0], target)
    sources = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths) - (not local))
    for i, p in enumerate(paths if local else paths[1:]):
        sources[i] = p
    if not len(sources):
        return
    if local:
        # The local file system keeps checksums of whole files; the raw one below it concatenates, without, and keeps the parts.
        store.getRawFileSystem().concat(place, sources)
    elif store.hasPathCapability(place, "fs.capability.paths.concat"):
        store.concat(place, sources)
        return
    else:
        out = store.append(place) if store.hasPathCapability(place, "fs.capability.paths.append") else _again(store, place)
        try:
            for p in sources:
                source = store.open(p)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()
    for p in parts if local else parts[1:]:
        delete(spark, p)


def _again(store, place):
    """A file to write to that begins with what is there; for stores that can't append, whose first part is a header."""
    source = store.open(place)
    head = source.readAllBytes()
    source.close()
    out = store.create(place, True)
    out.write(head)
    return out
