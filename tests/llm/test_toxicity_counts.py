"""The toxicity models against a brute-force version, what they count, and their defined results."""

import math
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from streamloom.llm import queries, toxicity


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def grams(word):
    b = b" " + word.encode() + b" "
    return [b[max(0, k - toxicity.ORDER + 1) : k + 1] for k in range(1, len(b))]


def packed(gram):
    return int.from_bytes(gram, "big")


def brute_counts(texts, classes):
    found = defaultdict(lambda: [0, 0])
    for text, y in zip(texts, classes, strict=True):
        for word in set(re.findall(r"\w+", (text or "").lower())):
            for g in grams(word):
                found[g][0] += y == 0
                found[g][1] += y == 1
    return found


def discount(counts):
    once, twice = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
    return once / (once + 2 * twice) if once else 0.5


def brute_ratios(counts):
    """log P1 - log P0 of each top gram, straight from the formulas. Grams are padded with zeros in front."""
    pad = lambda g, n: g.rjust(toxicity.ORDER, b"\0")[-n:]
    order = {n: defaultdict(lambda: [0, 0]) for n in range(1, toxicity.ORDER + 1)}
    for g, (c0, c1) in counts.items():
        for n in order:
            order[n][pad(g, n)][0] += c0
            order[n][pad(g, n)][1] += c1
    before = {n: defaultdict(set) for n in range(1, toxicity.SHARED + 1)}
    for n in before:
        for g in order[n + 1]:
            before[n][g[1:]].add(g[:1])
    p = {b"": (1 / 256, 1 / 256)}
    for n in range(1, toxicity.ORDER + 1):
        if n <= toxicity.SHARED:
            c = {g: (0, len(s)) for g, s in before[n].items()}
        else:
            c = order[n]
        d = discount([x[1] for x in c.values()])
        of = defaultdict(list)
        for g in c:
            of[g[:-1]].append(g)
        for h, gs in of.items():
            all0, all1 = (sum(c[g][y] for g in gs) for y in (0, 1))
            w = sum(min(c[g][1], d) for g in gs) / all1 if all1 else 1.0
            for g in gs:
                low0, low1 = p[g[1:]]
                p1 = max(c[g][1] - d, 0) / all1 + w * low1 if all1 else low1
                p0 = p1 if n <= toxicity.SHARED else (1 - w) * c[g][0] / all0 + w * low0 if all0 else low0
                p[g] = (p0, p1)
    return {packed(g): math.log(p[pad(g, toxicity.ORDER)][1] / p[pad(g, toxicity.ORDER)][0]) for g in counts}


@pytest.fixture
def corpus(spark):
    texts = [f"shared{i % 7} own{i} {'vile' if i % 4 == 0 else 'kind'}{i % 5} é{i % 3}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(90)], "doc_id long, toxic int")
    return texts, docs, labels


def test_counts_cover_all_rows_whatever_the_sample(spark, corpus):
    texts, docs, labels = corpus
    rows = docs.join(labels, "doc_id", "left").select("text", F.col("toxic").alias("y"))
    got = {r.gram: [r.c0, r.c1] for r in toxicity.count_grams(rows).collect()}
    want = brute_counts(texts, [int(i % 4 == 0) if i < 90 else None for i in range(120)])
    assert got == {packed(g): c for g, c in want.items()}
    # The whole training fold is counted but for the bounded calibration sample.
    small, large = (toxicity.train(docs, labels, sample_rows=n) for n in (8, 10**6))
    assert small.n_grams > 0 and large.n_grams > 0


def test_ratios_against_brute_force(spark, corpus):
    texts, docs, labels = corpus
    classes = [int(i % 4 == 0) if i < 90 else None for i in range(120)]
    rows = docs.join(labels, "doc_id", "left").select("text", F.col("toxic").alias("y"))
    got = {r.gram: r.ratio for r in toxicity.log_ratios(toxicity.count_grams(rows)).collect()}
    want = {g: r for g, r in brute_ratios(brute_counts(texts, classes)).items() if abs(r) > 1e-9}
    assert {g for g, r in got.items() if abs(r) > 1e-9} == set(want)
    assert all(abs(got[g] - want[g]) < 1e-9 for g in want)
    model = toxicity.train(docs, labels)
    scored = toxicity.differences(docs, model).collect()
    ratios = {r.gram: r.ratio for r in model.ratios.collect()}
    for r in scored:
        words = re.findall(r"\w+", r.text.lower())
        total = [sum(ratios.get(packed(g), 0) for g in grams(w)) for w in words]
        assert abs(r.difference - sum(math.log(toxicity.PLAIN + (1 - toxicity.PLAIN) * math.exp(t)) for t in total) / len(words)) < 1e-12
    # A table of ratios that is too large to send gives the same.
    joined = {r.doc_id: r.difference for r in toxicity.differences(docs, model, sent_grams=0).collect()}
    assert all(abs(joined[r.doc_id] - r.difference) < 1e-12 for r in scored)


def test_clashing_columns_long_texts_repeats_and_empty_tables(spark, corpus):
    _, docs, labels = corpus
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, "vile0 " * 60_000, 0.5, "d"), (1, "vile0 " * 60_000, 0.5, "d"), (None, None, 0.1, "e"), (2, "", None, None)], "doc_id long, text string, score double, difference string")
    got = toxicity.score(odd, model).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "score", "difference", "score_"}
    assert [r.score for r in got] == [0.1, 0.5, 0.5, None] and got[1].score_ == got[2].score_ != got[0].score_ == got[3].score_
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.differences(odd, model, sent_grams=0).count() == 4
    assert toxicity.train(docs.limit(0), labels).n_grams == 0


def test_held_out_rows(spark):
    found = queries.op1_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    rows = found.join(labels, "doc_id").where("held_out").toPandas()
    rank, ones = rows.score.rank(), rows.toxic == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.95
    assert (rows.predicted == rows.toxic).mean() > 0.95 and rows.predicted[ones].mean() > 0.8 and rows.predicted[~ones].mean() < 0.05
