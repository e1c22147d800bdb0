"""A pipeline for training data: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, whatever further ones these have.

Defined results of every stage: null and empty texts are rows like any other (without words: the classifier's bias decides,
they are near-copies of each other, hold no item and no personal data, and are packed as the end id alone); ties, repeated
rows and null ids are said at each stage; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import decontamination, packing, quality_model, surrogates
from streamloom.llm.common import materialize, numbered, without
from streamloom.llm.near_copies import near_copies
from streamloom.llm.queries import PII_KEY, tokenizer

QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; repeated rows are judged each."""
    weights = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_model.score(docs, weights)
    return scored.where(F.col(scored.columns[-1]) >= QUALITY_THRESHOLD).select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-copies (five-word Jaccard >= 0.8): the one with the smallest id; of several, and of
    null ids, the one that is read first.

    Rows are told apart by a key of file and position, not by their ids, which may be null or repeated. The rows that go are
    found first; of all texts only those that may be among them are shuffled."""
    rows, key, doc = numbered(docs)
    plain = rows.select(F.col(key).alias("key"), F.col(doc).getField("text").alias("text"))
    of = materialize(near_copies(plain), "dedup-components")
    ids = rows.select(F.col(key).alias("key"), F.col(doc).getField("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    stay = materialize(ids.join(of, "key").groupBy("component").agg(F.min(order).getField("key").alias("stays")), "dedup-stay")
    gone = materialize(of.join(stay, "component").where("key <> stays").select("key"), "dedup-gone")
    return without(rows, F.col(key), gone).select(f"{doc}.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are told apart by their ids: all rows of an id go if one holds an item."""
    leaks = materialize(decontamination.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("leak_id")).distinct(), "leaks")
    return without(docs, F.col("doc_id"), leaks)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; a column n_chars follows the text."""
    changed = surrogates.pseudonymise(docs, PII_KEY)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; null ids are kept, repeated rows packed each."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("private_data", private_data), ("pack", pack)]

#: Trained weights, SimHash and tokenizers are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
