"""The pipeline against a brute-force version of its stages."""

import re

import numpy as np
import pytest

import corpus_pipeline as p
from streamloom.llm import quality_model, surrogates
from streamloom.llm.features import HashedWords
from streamloom.llm.queries import tokenizer
from streamloom.llm.packing import chunk_ids
from tests.llm.test_decontamination import grams
from tests.llm.test_near_dedup import shingles

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.columns, [r.asDict() for r in docs.collect()]))
    return [("documents", None, [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]), *out]


def test_quality(spark, stages):
    before, after = stages[0][2], stages[1][2]
    w = quality_model.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).astype(np.float32)
    hashed = HashedWords(quality_model.PATTERN, quality_model.BUCKETS, False)

    def score(text):
        at, x = quality_model.vector(hashed, text)
        return 1 / (1 + np.exp(-(np.dot(w[at], x) + w[-1])))

    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if score(r["text"]) >= p.QUALITY_THRESHOLD)


def test_near_dedup(stages):
    """The contract of near-duplicates on word shingles: five words, Jaccard similarity of 0.8 or more."""
    before, after = stages[1][2], stages[2][2]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    label = {i: i for i in sets}
    while True:
        again = {a: min(label[b] for b in sets if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0) for a in sets}
        if again == label:
            break
        label = again
    assert sorted(r["doc_id"] for r in after) == sorted(i for i in sets if label[i] == i)


def test_decontaminate(spark, stages):
    items = [g for g in (grams(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()) if g]
    before, after = stages[2][2], stages[3][2]
    clean = [r["doc_id"] for r in before if not any(len(g & grams(r["text"])) >= 0.8 * len(g) - 1e-9 for g in items)]
    assert sorted(r["doc_id"] for r in after) == sorted(clean)


def test_private_data(stages):
    before, after = {r["doc_id"]: r for r in stages[3][2]}, {r["doc_id"]: r for r in stages[4][2]}
    assert set(before) == set(after) and stages[4][1] == ["doc_id", "text", "lang", "source", "n_chars"]
    pattern = re.compile(r"[\w.+-]+@[\w.-]+\.\w+|\b[0-9a-fA-F]{40}\b|\b\d{16}\b|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}\b")
    for i, r in before.items():
        old, new = pattern.findall(r["text"]), pattern.findall(after[i]["text"])
        assert len(old) == len(new) and not set(old) & set(new)
        assert pattern.sub("", r["text"]) == pattern.sub("", after[i]["text"])
    assert surrogates.ENTITY


def test_pack_and_run(spark, stages):
    docs, pieces = stages[4][2], stages[5][2]
    ids = chunk_ids(*tokenizer())
    assert {r["doc_id"]: sum(x["length"] for x in pieces if x["doc_id"] == r["doc_id"]) for r in docs} == {r["doc_id"]: len(ids.encode(r["text"])) // 4 + 1 for r in docs}
    key = lambda r: (r["doc_id"], r["start"])
    assert sorted((r.asDict() for r in p.run(spark, DATA).collect()), key=key) == sorted(pieces, key=key)


def test_odd_rows_in_every_stage(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns whose names clash, and empty tables."""
    words = " ".join(f"word{k % 997}" for k in range(30_000))
    rows = [(1, words, "en", None, 5, 0.5, "k"), (1, words, "en", None, 5, 0.5, "k"), (None, None, None, None, None, None, None), (2, "", "de", "w", 0, 0.1, "k"), (3, " \n ", None, "w", 3, None, "l"), (None, "Mr. John Smith wrote to a@b.com about it.", "en", "w", 9, 0.2, "m")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double, row string")
    kept = {}
    for name, stage in p.STAGES:
        got = stage(spark, odd, DATA)
        if name != "pack":
            assert got.columns == odd.columns
        kept[name] = got.collect()
        assert stage(spark, odd.limit(0), DATA).count() == 0
    assert len(kept["near_dedup"]) == 3 and len(kept["decontaminate"]) == len(kept["private_data"]) == 6
    assert sorted(r.doc_id or 0 for r in kept["near_dedup"]) == [0, 1, 2]
    assert {r.doc_id for r in kept["pack"]} == {1, 2, 3, None}
    assert all(r.score == 0.2 and "a@b.com" not in r.text for r in kept["private_data"] if r.row == "m")
