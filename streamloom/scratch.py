"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from streamloom.sources.files import qualified

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where it is unset and the session has local tasks only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="streamloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with its scheme; it is removed when this Python process ends."""
    path = qualified(spark, f"{shared_dir(spark)}/streamloom-{name}-{uuid.uuid4().hex}")
    if not _made:
        atexit.register(_remove, spark)
    _made.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it again: lineage is cut, and values that were drawn stay as they are."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 2)[-2] for f in df.inputFiles()}:
        for known in [p for p in _made if p.rsplit("/", 1)[-1] == name]:
            _delete(spark, known)
            _made.discard(known)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _remove(spark: SparkSession) -> None:
    for path in sorted(_made):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit; a scratch folder then stays  # noqa: BLE001
            return
        _made.discard(path)
