"""A quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Training: a bounded sample of labelled rows (features.labelled_sample) is dealt over shards by hash; each shard makes
FTRL-proximal updates over its rows in a fixed order, and the shards' weights are averaged. The model is one array
of 2**18 weights whatever the input. Scoring: the sparse dot product of a document's n-gram counts, scaled to length 1,
with the weights, in Arrow batches over whole texts.

Defined results: a null or empty text has no n-grams and gets the score of the bias alone; without labelled rows
all weights are zero and every score is 0.5; repeated rows are scored each; all columns of docs are kept, and where one has
the name of the new column, the new one gets "_" appended until it is free; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import free_name
from streamloom.llm.features import HashedWords, labelled_sample, pairs

BUCKETS = 1 << 18
#: Words, and signs one by one; case is kept.
PATTERN = r"\w+|[^\w\s]"
SAMPLE_ROWS = 12_000
#: Labelled rows that one shard learns from, about.
SHARD_ROWS = 2_000


def vector(hashed: HashedWords, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's words and word pairs; the values have length 1."""
    ids = hashed.ids(text)
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0)
    at, n = np.unique(np.concatenate([ids, pairs(ids, BUCKETS)]), return_counts=True)
    return at, n / np.sqrt(np.dot(n, n))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.0005) -> np.ndarray:
    """Weights after FTRL-proximal updates with a learning rate for each coordinate; the last weight is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        big = np.abs(z[at]) > l1
        return np.where(big, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(np.dot(w, x), -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """The averaged weights of all shards."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords(PATTERN, BUCKETS, lower=False)
        for b in batches:
            found = [vector(hashed, t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))],
                names=["shard", "y", "at", "x"],
            )

    def fit(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("at").to_pylist(), table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True))
        order = np.random.default_rng(3).permutation(len(rows))
        w = ftrl([(np.array(rows[k][0], np.int64), np.array(rows[k][1]), rows[k][2]) for k in order])
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array(at.astype(np.int32)), "w": pa.array(w[at]), "one": pa.array(np.ones(len(at)))})

    sample = labelled_sample(docs, labels, label, sample_rows, id_col, text_col)
    shards = max(1, round(min(sample_rows, labels.count()) / shard_rows))
    dealt = sample.select(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(shards)).alias("shard"), "y", "text")
    fitted = dealt.mapInArrow(extract, "shard long, y int, at array<int>, x array<float>").groupBy("shard").applyInArrow(fit, "at int, w double, one double")
    mean = fitted.groupBy("at").agg(F.sum("w").alias("w")).toPandas()
    out = np.zeros(BUCKETS + 1)
    out[mean["at"].to_numpy()] = mean["w"].to_numpy() / shards
    return out


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashed, w = HashedWords(PATTERN, BUCKETS, lower=False), shared.value
        for texts in batches:
            logits = np.empty(len(texts))
            for k, text in enumerate(texts):
                at, x = vector(hashed, text)
                logits[k] = np.dot(w[at], x) + w[BUCKETS]
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -35, 35))))

    return docs.withColumn(free_name(docs.columns, out), run(F.col(f"`{text_col}`")))
