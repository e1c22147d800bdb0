"""The trie of conversation prefixes against one that is built in memory."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from streamloom.llm import prefix_trie as pt
from streamloom.llm import queries

DATA = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture
def many_ranges(spark):
    """Ranges of a few rows, so that conversations go over several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in found.items()}
    nodes = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    out, below = [], {}
    for key in sorted(nodes, key=len, reverse=True):
        kids = [k for k in below if len(k) == len(key) + 1 and k[:-1] == key]
        n = len(nodes[key])
        below[key] = (1 if not kids else sum(below[k][0] for k in kids), (n - 1) * (len(key[-1][1]) if key else 0) + sum(below[k][1] for k in kids))
        ends = ",".join(str(c) for c in sorted(c for c, e in nodes[key] if e))
        up = min(c for c, _ in nodes[key[:-1]]) if key else None
        out.append((min(c for c, _ in nodes[key]), len(key), up, n, len(kids), *below[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 450), n):
        for turn in range(rng.choice([1, 2, 3, longest])):
            # Few words, so that prefixes are shared beyond the given turns.
            rows.append((c, turn, rng.choice(["user", "user", "assistant"]), rng.choice(["a", "bb", "über"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("members", [2, 3, 1024])
def test_small_tries(many_ranges, members):
    rows = made(members)
    got = pt.prefix_trie(many_ranges.createDataFrame(rows, KIND), members)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == plain(rows)


def test_long_conversations_and_many_copies(many_ranges):
    rows = [(c, t, "user", f"t{t}") for c in (0, 7, 11) for t in range(400)]
    rows += [(c, t, "user", "same") for c in range(500, 700) for t in range(3)]
    rows += [(c, t, "user", "x" * (t + 1)) for c in range(1000, 1030) for t in range(c - 999)]
    got = pt.prefix_trie(many_ranges.createDataFrame(rows, KIND), 4)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == plain(rows)


def test_nulls_ties_repeats_and_other_columns(many_ranges):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (2, 0, None, ""), (2, 5, "user", "y"), (100, 0, "u", ""), (103, 0, "u", ""), (103, None, "u", "first"), (101, 3, "u", "long" * 100_000)]
    df = many_ranges.createDataFrame([(*r, i, "z") for i, r in enumerate(rows)], f"{KIND}, e1 int, part string")
    got = pt.prefix_trie(df)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == plain(rows)
    assert pt.prefix_trie(many_ranges.createDataFrame([], KIND)).count() == 0
    only_null = many_ranges.createDataFrame(rows[:1], KIND)
    assert pt.prefix_trie(only_null).count() == 0


def test_texts_of_nodes(spark):
    rows = made(9, 20)
    df = spark.createDataFrame(rows, KIND)
    nodes = pt.with_texts(pt.prefix_trie(df), df)
    found = {(r.conv_id, r.depth): (r.role, r.text) for r in nodes.collect()}
    assert len(found) == len(plain(rows)) and [v for (_, d), v in found.items() if d == 0] == [(None, None)]
    firsts = {(r, t) for c, turn, r, t in rows if turn == 0}
    assert {v for (_, d), v in found.items() if d == 1} <= {(r, t) for _, _, r, t in rows} and firsts


def test_louds_of_a_forest():
    rng = np.random.default_rng(2)
    for m in (0, 1, 2, 50, 500):
        parent = np.array([rng.integers(-1, i) if i else -1 for i in range(m)], np.int64)
        mixed = rng.permutation(m)
        shuffled = np.full(m, -1)
        shuffled[mixed] = np.where(parent >= 0, mixed[parent], -1) if m else []
        order, bits, starts = pt.louds(shuffled)
        assert sorted(order) == list(range(m)) and len(bits) == 2 * m + 1 and bits.sum() == m and starts[-1] == m
        up = pt.parents_of(bits)
        assert [order[p] if p >= 0 else -1 for p in up] == shuffled[order].tolist()


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    got = queries.op12_prefix_trie(spark, DATA)
    found = db.execute(pt.ORACLE)
    assert [c[0] for c in found.description] == got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(found.fetchall(), key=repr)
