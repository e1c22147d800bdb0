"""Toxicity: two class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

The models spell words byte by byte: a byte follows at most ORDER - 1 bytes of its word, so that rare expressions share what
their parts have in common. Orders up to SHARED are Kneser-Ney's continuation counts (how many different bytes come before a
gram) over all documents, labelled or not. Above, a class's probability is interpolated with the order below,

    P1(b | h) = max(c1(h b) - D, 0) / c1(h) + w(h) P1(b | h'),    w(h) = sum over b of min(c1(h b), D) / c1(h)
    P0(b | h) = (1 - w(h)) c0(h b) / c0(h)  + w(h) P0(b | h'),

with c = number of labelled documents of the class with the word of the gram, and D = n1 / (n1 + 2 n2) from counts of counts.
The toxic class, the smaller one, gives one backoff weight to both: with its own, larger sample the ordinary class would
back off less for its size alone, and every rare word would tell the classes apart.

A toxic document is ordinary prose with few toxic expressions, so that a word of it is drawn from P1 with probability
1 - PLAIN and from P0 else. A document's difference is the mean over its words of log(PLAIN + (1 - PLAIN) P1 / P0).

Grams are packed into longs; counts, discounts and probabilities are DataFrame aggregates and joins over the table of
distinct grams, and only tasks see texts. The table of ratios is sent to all tasks up to SENT_GRAMS rows; a larger one is joined by gram
and word. A bounded sample of labelled rows is left out of the class counts and calibrates differences into scores.

Defined results: a null or wordless text has difference 0 and gets the calibration's intercept; without labelled rows of
both classes every score is 0 (below 1e-15); repeated rows are scored each; all columns of docs are kept, and where one has
the name of the new column, the new one gets "_" appended until it is free; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.common import free_name, held_out, materialize

WORD = re.compile(r"\w+")
#: Bytes of a gram, and the highest order that all documents share.
ORDER, SHARED = 5, 3
#: Probability that a word of a toxic document is as in any other.
PLAIN = 0.95
SAMPLE_ROWS = 24_000
#: Most words that a task keeps before it sends their grams on, and most that it remembers the value of.
HELD_WORDS = 400_000
#: Texts whose words are looked up at once.
LEARNT_TEXTS = 64
#: Up to so many labels are broadcast, so that texts stay where they are; more are joined by a shuffle.
SENT_LABELS = 1 << 20
#: Up to so many grams of a model (16 bytes each) are sent to every task.
SENT_GRAMS = 1 << 22


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of each word and at the blank after it, and the word's number. The blank before a word
    is the first byte of its first grams."""
    spelt = [w.encode() for w in words]
    b = np.frombuffer(b" " + b" ".join(spelt) + b" ", np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, spelt), np.int64, len(spelt)) + 1
    owner = np.repeat(np.arange(len(spelt)), lengths)
    since = np.arange(1, len(b)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = np.zeros(len(owner), np.int64)
    for i in range(ORDER):
        before = b[1 - i : len(b) - i] if i <= 1 else np.concatenate((np.zeros(i - 1, np.int64), b[: len(b) - i]))
        keys |= np.where(i <= since, before, 0) << (8 * i)
    return keys, owner


def count_grams(rows: DataFrame) -> DataFrame:
    """gram, c0, c1 of every gram of rows (text, y): the documents of each class by words that have it. y is null for rows of
    no class, whose grams come with zeros."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter(), Counter()]

        def grams() -> pa.RecordBatch:
            words = list(set().union(*seen))
            keys, owner = word_grams(words)
            at, inverse = np.unique(keys, return_inverse=True)
            sums = [np.bincount(inverse, np.fromiter(map(seen[y].__getitem__, words), np.int64, len(words))[owner], len(at)).astype(np.int64) for y in (0, 1)]
            return pa.RecordBatch.from_pydict({"gram": pa.array(at), "c0": pa.array(sums[0]), "c1": pa.array(sums[1])})

        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[y].update(set(WORD.findall((text.as_py() or "").lower())))
                if sum(map(len, seen)) >= HELD_WORDS:
                    yield grams()
                    seen = [Counter(), Counter(), Counter()]
        if any(seen):
            yield grams()

    of_class = F.when(F.col("y").isNull(), 2).otherwise(F.least(F.greatest("y", F.lit(0)), F.lit(1)))
    found = rows.select("text", of_class.cast("long").alias("y")).mapInArrow(extract, "gram long, c0 long, c1 long")
    return found.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _suffix(order: int):
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))


def _discount(counts: DataFrame, column: str) -> float:
    """n1 / (n1 + 2 n2) of a column of counts; 0.5 where no count is 1."""
    once, twice = counts.agg(F.count_if(F.col(column) == 1), F.count_if(F.col(column) == 2)).first()
    return once / (once + 2 * twice) if once else 0.5


def _of_history(column) -> object:
    return F.sum(column).over(Window.partitionBy(F.shiftright("gram", 8)))


def log_ratios(counts: DataFrame) -> DataFrame:
    """gram, ratio of counts (gram, c0, c1): log P1 - log P0 of the gram's last byte, where the models differ."""
    tables = {ORDER: materialize(counts, "toxicity-grams")}
    for n in range(ORDER - 1, 0, -1):
        below = tables[n + 1].groupBy(_suffix(n).alias("gram"))
        # Class orders add up the documents, shared orders count the different bytes before a gram.
        summed = below.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")) if n > SHARED else below.agg(F.count("*").alias("c"))
        tables[n] = materialize(summed, f"toxicity-grams{n}")
    p = None
    for n in range(1, ORDER + 1):
        t = tables[n]
        if p is not None:
            t = t.join(p.withColumnRenamed("gram", "low"), _suffix(n - 1) == F.col("low"))
        else:
            t = t.withColumns({"p0": F.lit(1 / 256), "p1": F.lit(1 / 256)})
        if n <= SHARED:
            d = _discount(tables[n], "c")
            t = t.withColumn("all", _of_history(F.col("c")))
            t = t.withColumn("w", _of_history(F.least("c", F.lit(d))) / F.col("all"))
            own = F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("all") + F.col("w") * F.col("p1")
            p = t.select("gram", own.alias("p0"), own.alias("p1"))
        else:
            d = _discount(tables[n], "c1")
            t = t.withColumns({"all0": _of_history(F.col("c0")), "all1": _of_history(F.col("c1")), "lost": _of_history(F.least("c1", F.lit(d)))})
            t = t.withColumn("w", F.when(F.col("all1") > 0, F.col("lost") / F.col("all1")).otherwise(1.0))
            share0 = F.when(F.col("all0") > 0, F.col("c0") / F.greatest("all0", F.lit(1)))
            p0 = F.when(F.col("all0") > 0, (1 - F.col("w")) * share0 + F.col("w") * F.col("p0")).otherwise(F.col("p0"))
            p1 = F.when(F.col("all1") > 0, F.greatest(F.col("c1") - d, F.lit(0.0)) / F.greatest("all1", F.lit(1)) + F.col("w") * F.col("p1")).otherwise(F.col("p1"))
            p = t.select("gram", p0.alias("p0"), p1.alias("p1"))
        p = materialize(p, f"toxicity-order{n}")
    return materialize(p.select("gram", (F.log("p1") - F.log("p0")).alias("ratio")).where("abs(ratio) > 1e-12"), "toxicity-ratios")


@dataclass
class Model:
    """Ratios by gram, and the calibration score = 1 / (1 + exp(-(a x + b)))."""

    ratios: DataFrame
    n_grams: int
    a: float = 0.0
    b: float = -35.0


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b with score 0.5 at the cut that gets most rows right (halfway between two of them), and the slope at which the
    toxic rows beyond the cut have a median score of 0.9."""
    order = np.argsort(-x, kind="stable")
    gain = np.cumsum(2 * y[order] - 1)
    k = int(np.argmax(gain))
    cut = (x[order[k]] + x[order[min(k + 1, len(x) - 1)]]) / 2
    beyond = x[(y == 1) & (x > cut)]
    a = np.log(9) / max(float(np.median(beyond)) - cut, 1e-6) if len(beyond) else 1.0
    return float(a), float(-a * cut)


def word_values(total: np.ndarray) -> np.ndarray:
    """log(PLAIN + (1 - PLAIN) exp(total)) of the summed ratios of words."""
    return np.logaddexp(np.log(PLAIN), np.log1p(-PLAIN) + total)


class WordValues(dict):
    """word -> its share of a document's difference."""

    def __init__(self, grams: np.ndarray, ratios: np.ndarray):
        self.grams, self.ratios = grams, ratios

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > HELD_WORDS:
            self.clear()
            new = list(words)
        if not new:
            return
        keys, owner = word_grams(new)
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        found = np.where(self.grams[at] == keys, self.ratios[at], 0.0)
        self.update(zip(new, word_values(np.bincount(owner, found, len(new))).tolist(), strict=True))


def _sent(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    table = model.ratios.orderBy("gram").toArrow() if model.n_grams else pa.table({"gram": [0], "ratio": [0.0]})
    shared = docs.sparkSession.sparkContext.broadcast((table.column("gram").to_numpy(), table.column("ratio").to_numpy()))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        values = WordValues(*shared.value)
        for texts in batches:
            means = np.zeros(len(texts))
            for first in range(0, len(texts), LEARNT_TEXTS):
                split = [WORD.findall((text or "").lower()) for text in texts[first : first + LEARNT_TEXTS]]
                values.learn(set().union(*split))
                for k, words in enumerate(split, first):
                    if words:
                        means[k] = sum(map(values.__getitem__, words)) / len(words)
            yield pd.Series(means)

    return docs.withColumn(out, run(F.col(f"`{text_col}`")))


def _joined(docs: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """As _sent, for a table of ratios of any size: words meet it by gram, and documents their words by word."""
    row = free_name(docs.columns, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "toxicity-rows")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words, n = np.unique(WORD.findall((text.as_py() or "").lower()), return_counts=True)
                yield pa.RecordBatch.from_pydict({"row": pa.array([at] * len(words), pa.int64()), "word": pa.array(words.tolist(), pa.string()), "n": pa.array(n)})

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            keys, owner = word_grams(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_pydict({"word": pa.array([words[k] for k in owner], pa.string()), "gram": pa.array(keys)})

    of = materialize(rows.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")).mapInArrow(split, "row long, word string, n long"), "toxicity-words")
    grams = of.select("word").distinct().mapInArrow(spell, "word string, gram long")
    totals = grams.join(model.ratios, "gram", "left").groupBy("word").agg(F.sum(F.coalesce("ratio", F.lit(0.0))).alias("total"))
    values = materialize(totals.select("word", F.log(F.lit(PLAIN) + F.lit(1 - PLAIN) * F.exp("total")).alias("value")), "toxicity-values")
    means = of.join(values, "word").groupBy(F.col("row").alias(row)).agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias(out))
    return rows.join(materialize(means, "toxicity-means"), row, "left").select(*(f"`{c}`" for c in docs.columns), F.coalesce(out, F.lit(0.0)).alias(out))


def differences(docs: DataFrame, model: Model, text_col: str = "text", out: str = "difference", sent_grams: int = SENT_GRAMS) -> DataFrame:
    """docs with the mean difference of log-likelihoods a word."""
    out = free_name(docs.columns, out)
    return (_sent if model.n_grams <= sent_grams else _joined)(docs, model, text_col, out)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Class counts from the labelled rows, shared counts from all rows; calibration on a quarter of a sample of the labelled
    ones, which the class counts leave out. A label that is null counts as absent; of several, the largest holds."""
    usable = labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    n = usable.count()
    share = min(1 << 30, (sample_rows << 30) // max(1, n))
    known = materialize(usable.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label).cast("int").alias("y")), "toxicity-labels")
    fold = F.crc32(F.col("label_id").cast("string").cast("binary")) % 5
    calibrates = (fold == 4) & (F.pmod(F.xxhash64(F.lit(11), F.col("label_id")), F.lit(1 << 30)) < share)
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counts = known.where(~calibrates)
    counted = text.join(F.broadcast(counts) if n <= SENT_LABELS else counts, F.col("id") == F.col("label_id"), "left")
    ratios = log_ratios(count_grams(counted))
    model = Model(ratios, ratios.count())
    sample = text.join(F.broadcast(known.where(calibrates)), F.col("id") == F.col("label_id")).select("text", "y")
    rest = differences(sample, model).select("difference", "y").toPandas()
    if model.n_grams and rest["y"].nunique() == 2:
        model.a, model.b = calibrate(rest["difference"].to_numpy(), rest["y"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores between 0 and 1."""
    named = free_name(docs.columns, "difference")
    rows = differences(docs, model, text_col, named)
    x = F.lit(model.a) * F.col(named) + F.lit(model.b)
    return rows.select(*(f"`{c}`" for c in docs.columns), (1 / (1 + F.exp(-x))).alias(free_name(docs.columns, out)))
