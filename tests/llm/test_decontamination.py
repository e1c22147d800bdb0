"""Containment of benchmark items against brute force."""

import re

import numpy as np

from streamloom.llm import decontamination as d


def grams(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = set()
    for i, t in docs:
        for j, q in items:
            g = grams(q)
            n = len(g & grams(t))
            if g and n >= 0.8 * len(g) - 1e-9:
                out.add((i, j, n, len(g)))
    return out


def cases():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(300)]

    def words(n):
        return list(rng.choice(vocabulary, n))

    items = [(j, " ".join(words(int(rng.integers(3, 60))))) for j in range(25)] + [(100, None), (101, ""), (102, "four words are few"), (3, "again " * 3)]
    docs = [(i, " ".join(words(int(rng.integers(1, 300))))) for i in range(40)]
    for j, q in items[:20]:
        w = q.split()
        docs.append((100 + j, " ".join(words(200) + w + words(50)).upper() + "!"))
        for k in range(0, len(w), 12):
            w[k] = "other"
        docs.append((200 + j, ", ".join(words(20) + w)))
        docs.append((300 + j, q[: len(q) * 9 // 10]))
    long = " ".join(words(40_000) + items[5][1].split() + words(10))
    return docs + [(900, None), (901, ""), (902, long), (100, docs[41][1]), (None, items[6][1])], items


def test_matches_brute_force(spark):
    docs, items = cases()
    got = d.contained(spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, hits int"), spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, sketch int"))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()} == brute(docs, items)
    # More shingles of items than may be sent to all tasks.
    other = d.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), sent=0)
    assert sorted(map(tuple, other.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.contained(docs.limit(0), items).count() == 0
    assert d.contained(docs, items.limit(0)).count() == 0
    assert d.contained(docs, items).first().containment == 1.0
