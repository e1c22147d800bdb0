"""Hashed words for the trained classifiers, and their samples of labelled rows."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import held_out

#: Most words that a Python worker remembers the hash of.
REMEMBERED = 400_000


class HashedWords(dict):
    """word -> bucket; words come from a pattern over the text, lower-cased if asked for."""

    def __init__(self, pattern: str, buckets: int, lower: bool):
        self.find, self.buckets, self.lower = re.compile(pattern).findall, buckets, lower

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = zlib.crc32(word.encode()) % self.buckets
        return found

    def ids(self, text: str | None) -> np.ndarray:
        words = self.find((text or "").lower() if self.lower else text or "")
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def pair_bucket(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of an ordered pair of word buckets."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def pairs(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word with the one before it."""
    return pair_bucket(ids[:-1], ids[1:], buckets)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and y of about `rows` labelled documents at most, none of them held out.

    The sample is those whose hash of the id is smallest, cut at the share that `rows` is of all labelled ids, so its size
    is bounded by the parameter and it may be broadcast. A label that is null counts as absent; of several, the largest holds.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    total = max(1, known.count())
    share = min(1 << 30, (rows << 30) // total)
    chosen = known.where(F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 30)) < share).groupBy(F.col(id_col).alias("sample_id")).agg(F.max(label).cast("int").alias("y"))
    text = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text"))
    return text.join(F.broadcast(chosen), "sample_id").select(F.col("sample_id").alias("doc_id"), "text", "y")
