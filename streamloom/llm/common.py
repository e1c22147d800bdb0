"""What the operators of this subpackage share: rows by keys, text normalisation, held-out folds, and intermediate tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.scratch import discard, fresh_path, materialize  # noqa: F401

#: The ASCII white space that separates words in every contract, as a class for Java, RE2 and Python.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Bits of the table that tells which keys may be in a set, and of one of its rows.
KEY_BITS, ROW_BITS = 1 << 23, 32_768


def likely(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with a key that may be among ids (one column, of the same type), and rows whose key surely is not.

    A table of KEY_BITS bits, of that size whatever the input, is broadcast and tells them apart, so that a join with ids
    shuffles the first part only. A crowded table costs time and loses nothing. A null key is like any other value."""
    slot = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(KEY_BITS))
    bits = ids.select(slot.alias("slot")).groupBy(F.expr(f"slot div {ROW_BITS}").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % ROW_BITS).alias("bits"))
    bits = materialize(bits, "likely")
    names = [free_name(rows.columns, n) for n in ("slot", "part", "bits")]
    slotted = rows.withColumn(names[0], F.pmod(F.xxhash64(key), F.lit(KEY_BITS)))
    met = slotted.join(F.broadcast(bits.toDF(*names[1:])), F.expr(f"{names[0]} div {ROW_BITS}") == F.col(names[1]), "left")
    at = F.col(names[0]) % ROW_BITS
    byte = F.conv(F.hex(F.substring(names[2], (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast({names[0]} % 8 AS int))")) != 0, F.lit(False))
    columns = [f"`{c}`" for c in rows.columns]
    return met.where(found).select(*columns), met.where(~found).select(*columns)


def without(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """rows but those whose key is among ids (one column); only rows that may go are shuffled."""
    maybe, stay = likely(rows, key, ids)
    name = free_name(rows.columns, "gone")
    left = maybe.join(ids.toDF(name), key.eqNullSafe(F.col(name)), "left_anti")
    return left.unionByName(stay)


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with a long that tells its rows apart, the same whenever they are read; the names of that column and of a struct
    of all columns of docs, which are the only two. Tables that are not read from Parquet files are written first."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    try:
        if any(c.lower() == "_metadata" for c in docs.columns):
            raise AnalysisException("a column has the name of the files' metadata")
        boxed = docs.select(doc, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        boxed = materialize(docs.select(doc), "numbered").select("doc", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    # One row for each file; the driver has listed them already.
    files = sorted(r.file for r in boxed.select("file").distinct().collect())
    table = docs.sparkSession.createDataFrame(list(enumerate(files)), "number long, file string")
    key = F.shiftleft("number", 36).bitwiseOR(F.col("at"))
    return boxed.join(F.broadcast(table), "file").select("doc", key.alias("key")), "key", "doc"


def free_name(taken: list[str], name: str) -> str:
    """name, with "_" appended until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all ids that no model learns from; a null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda variable keeps the optimiser from copying it into nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
