"""Removal of repeated passages against brute force."""

import hashlib
from collections import Counter

import numpy as np

from streamloom.llm import substrings as s


def brute(texts, size=s.SIZE):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in datas for i in range(len(d) - size + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), len(s._runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    def words(n):
        return " ".join("".join(rng.choice(list("abcdeéß"), int(rng.integers(2, 9)))) for _ in range(n))

    p, q = words(150), words(90)
    near = words(260)
    docs = [words(200) + p + words(20), p + words(50), words(10) + p[100:900] + words(9), q + q, q[:399], "a" * 1200, "ab" * 500, "", None, "short", words(300)]
    for k in range(12):
        cut = int(rng.integers(0, len(near)))
        docs.append(near[:cut] + f"#{k}#" + near[cut:])
    copy = words(100)
    return [*docs, copy, copy, "x" * 399, "x" * 399, words(120) + "\n" + p[:400], p[1:401] + words(40)]


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.remove_repeats(df, **kw).collect()}


def test_matches_brute_force(spark):
    texts = corpus(np.random.default_rng(2))
    assert run(spark, texts) == dict(enumerate(brute(texts)))


def test_crowded_anchors_are_split_without_loss(spark):
    texts = corpus(np.random.default_rng(3))
    assert run(spark, texts, crowded=2, bucket=4) == dict(enumerate(brute(texts)))


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.remove_repeats(df).count() == 0
    two = spark.createDataFrame([(None, "y" * 500), (None, "z z" * 200)], "doc_id long, text string")
    assert sorted(r.n_removed for r in s.remove_repeats(two).collect()) == [500, 600]


def test_passages_of_over_fifty_words_that_are_shorter_than_size(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 9000, n))
    short, other = words(51), words(70)
    assert len(short) < s.SIZE
    clean = [words(int(n)) for n in rng.integers(1, 300, 60)]
    copied = words(90)
    texts = [f"{words(30)} {short} {words(9)}", f"{words(3)} {short}", f"{other}\n{words(40)}", f"{words(80)} {other}", *clean, copied, copied, "Shti " * 300, "Shti " * 200 + words(60), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in s.remove_repeats(df).collect()}
    assert {i for i, r in got.items() if r.n_shared} == {0, 1, 2, 3}
    assert got[0].n_removed == got[1].n_removed == 0 and got[64].n_removed == len(copied)
