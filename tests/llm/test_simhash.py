"""SimHash against brute force."""

import numpy as np
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.llm import simhash
from streamloom.llm.components import components

DOCS = "doc_id long, text string, fp string, component_id int"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ß", "don't"]
    out = {}
    for i in range(40):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 120))))
        out[i] = " ".join(words)
        if len(words) > 60:
            words[30] = "changed"
            out[i + 100] = "\n".join(words).upper()
    out |= {200: "", 201: None, 202: " \t\n", 203: "one", 204: "ONE", 205: "a b", 206: out[3] + " tail", 207: "long word " * 20000}
    return out


def test_components_match_brute_force(spark):
    given = texts()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in given.items()], DOCS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()}
    prints = {i: brute_print(t) for i, t in given.items()}
    assert {i: v[0] for i, v in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: v[1] for i, v in got.items()} == brute_components(prints)


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(7, "x y z"), (7, "x y z"), (None, "x y z"), (None, "only null here"), (3, "x y z")]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in got if r.component_id is not None) == [(False, 3, 3), (False, 7, 3), (False, 7, 3), (True, None, 3)]
    assert sum(r.component_id is None for r in got) == 1
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_subtrees_are_split_without_loss(spark):
    rng = np.random.default_rng(1)
    x = np.unique((rng.integers(0, 1 << 14, 900, dtype=np.uint64) << np.uint64(40)) | np.uint64(5 << 60))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    label = {r.node: r.label for r in components(simhash.links(df, pair_rows=64)).collect()}
    want = brute_components({int(v): int(v) for v in x})
    groups = {}
    for v in x:
        groups.setdefault(want[int(v)], set()).add(int(v))
    found = {}
    for v in x:
        found.setdefault(label.get(int(v.view(np.int64)), int(v.view(np.int64))), set()).add(int(v))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    got = components(spark.createDataFrame([*chain, *hub, (5, 5), (None, 1)], T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])))
    labels = got.groupBy("label").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in labels) == [301, 400]
