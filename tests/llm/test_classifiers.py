"""Held-out accuracy of the two trained classifiers, and their defined results."""

import numpy as np
from pyspark.sql import functions as F

from streamloom.llm import quality_model, queries, toxicity

DATA = "/root/testdata/sf0.01"


def measured(spark, found, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    rank = rows.score.rank()
    ones = rows.y == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    return (rows.predicted == rows.y).mean(), auc


def test_quality_on_held_out_rows(spark):
    accuracy, auc = measured(spark, queries.op6_quality_classifier(spark, DATA), "quality")
    assert accuracy > 0.92 and auc > 0.97


def test_toxicity_finds_planted_expressions(spark):
    rng = np.random.default_rng(0)
    plain = [f"w{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(1500):
        words = list(rng.choice(plain, 80))
        if i % 5 == 0:
            for k in rng.integers(0, 80, 4):
                words[k] = str(rng.choice(["vile", "awful", "nasty"]))
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(i % 5 == 0), None))
    docs += [(5000, None, "clash"), (5001, "", "clash"), (5002, " \n", "clash")]
    df = spark.createDataFrame(docs, "doc_id long, text string, difference string")
    lab = spark.createDataFrame(labels + [(7, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(df, lab)
    got = {r.doc_id: r.score for r in toxicity.score(df.drop("difference"), model).collect()}
    right = np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in range(1500)])
    assert right > 0.95
    assert got[5000] == got[5001] == got[5002] < 0.5


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(df, toxicity.train(df, none)).first().score < 1e-15
    weights = quality_model.train(df, none)
    assert quality_model.score(df, weights).first().score == 0.5
    assert quality_model.score(df.limit(0), weights).count() == 0


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(1)
    rows = [(np.array([y, 2 + int(rng.integers(0, 50))]), np.array([0.8, 0.6]), int(y)) for y in rng.integers(0, 2, 400)]
    w = quality_model.ftrl(rows)
    assert w[1] > 1 > -1 > w[0] and (w == 0).mean() > 0.9


def test_ftrl_against_the_formulas():
    """FTRL-proximal, coordinate by coordinate, in plain Python."""
    rng = np.random.default_rng(7)
    rows = [(np.unique(rng.integers(0, 30, 6)), int(rng.integers(0, 2))) for _ in range(120)]
    rows = [(at, np.full(len(at), 1 / np.sqrt(len(at))), y) for at, y in rows]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.01, 0.1
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - (l1 if z[k] > 0 else -l1)) / ((beta + n[k] ** 0.5) / alpha + l2)

    for _ in range(2):
        for at, x, y in rows:
            items = [*zip(at.tolist(), x.tolist()), (quality_model.BUCKETS, 1.0)]
            w = {k: weight(k) for k, _ in items}
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in items)))
            for k, v in items:
                g = (p - y) * v
                sigma = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / alpha
                z[k], n[k] = z.get(k, 0.0) + g - sigma * w[k], n.get(k, 0.0) + g * g
    got = quality_model.ftrl(rows, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert all(abs(got[k] - weight(k)) < 1e-9 for k in z) and np.count_nonzero(got) == sum(weight(k) != 0 for k in z)


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(i, f"good words {i}" if i % 2 else f"bad terms {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    weights = quality_model.train(df, labels)
    odd = spark.createDataFrame([(1, "good words " * 40_000, 0.5), (1, "good words " * 40_000, 0.5), (None, None, None), (2, "", 0.1)], "doc_id long, text string, score double")
    got = quality_model.score(odd, weights).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "score", "score_"} and [r.score for r in got] == [None, 0.5, 0.5, 0.1]
    assert got[1].score_ == got[2].score_ > 0.5 and got[0].score_ == got[3].score_
    assert quality_model.score(odd.limit(0), weights).count() == 0
