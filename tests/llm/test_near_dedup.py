"""Near-duplicates of the pipeline where ids don't tell rows apart."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from streamloom.llm import near_copies as nc
from streamloom.llm.common import likely, without

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], COLUMNS)


def words(start, n=40):
    return " ".join(f"w{start + k}" for k in range(n))


def test_null_and_repeated_ids_with_different_texts(spark):
    a, b, c, d, e = (words(1000 * k) for k in range(5))
    rows = [(None, a), (None, b), (7, c), (7, d), (3, e), (7, e), (9, a), (None, b)]
    got = [(r.doc_id, r.text) for r in p.near_dedup(spark, frame(spark, rows), "").collect()]
    assert sorted(got, key=repr) == sorted([(9, a), (None, b), (7, c), (7, d), (3, e)], key=repr)
    assert p.near_dedup(spark, frame(spark, []), "").count() == 0


def shingles(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_near_copies_against_brute_force_jaccard(spark):
    rng = np.random.default_rng(3)
    texts = {}
    for i in range(30):
        base = list(rng.choice([f"w{k}" for k in range(500)], int(rng.integers(80, 300))))
        texts[i] = " ".join(base)
        for v in range(3):
            changed = list(base)
            for k in rng.integers(0, len(base), int(rng.integers(1, 6))):
                changed[k] = "changed"
            texts[100 * (v + 1) + i] = "\n".join(changed).upper() if v == 0 else " ".join(changed)
    texts |= {900: None, 901: "", 902: "one two", 903: "ONE  two", 904: "one three"}
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    while True:
        again = {a: min(label[b] for b in texts if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0) for a in texts}
        if again == label:
            break
        label = again
    want = sorted({label[i] for i in texts})
    df = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in texts.items()], COLUMNS)
    assert sorted(r.doc_id for r in p.near_dedup(spark, df, "").collect()) == want


def test_crowded_keys_are_compared_in_chunks(spark):
    """Members of one key that are not alike the first of it are found, chunk by chunk."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(400, 60)) for _ in range(20)]
    sets += [np.unique(np.concatenate((s[:-2], rng.choice(400, 2)))) for s in sets for _ in range(3)]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(i, j) for i in range(80) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8}
    got = nc.meetings(np.arange(80), np.arange(80), sets, 0.8)
    assert {(max(p), min(p)) for p in got} == want
    assert nc.meetings(np.arange(80), np.zeros(80, int), sets, 0.8) == []
    texts = [(i, " ".join(f"w{k}" for k in range(20 * i, 20 * i + 40))) for i in range(12)]
    copies = [(100 + i, t.replace("w", "w", 1) + " tail") for i, t in texts]
    rows = spark.createDataFrame(texts + copies, "key long, text string")
    members = rows.select(F.lit(1).cast("long").alias("band"), F.col("key").alias("node"), F.col("key").alias("label"))
    links = nc._rest(members, rows, 5, 0.8, 4).distinct().collect()
    assert {(min(r.u, r.v), max(r.u, r.v)) for r in links} == {(i, 100 + i) for i in range(12)}


def test_rows_told_apart_by_bits(spark):
    rows = spark.range(5000).selectExpr("if(id = 7, null, id) AS id", "id AS bits", "'x' AS slot")
    ids = spark.createDataFrame([(5,), (4999,), (None,), (77777,)], "id long")
    maybe, rest = likely(rows, F.col("id"), ids)
    assert maybe.columns == rest.columns == rows.columns and maybe.count() + rest.count() == 5000
    assert {5, 4999, None} <= {r.id for r in maybe.collect()} and maybe.count() < 20
    assert {r.bits for r in rows.exceptAll(without(rows, F.col("id"), ids)).collect()} == {5, 7, 4999}
    assert without(rows, F.col("id"), ids.limit(0)).count() == 5000
