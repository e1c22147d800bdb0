"""Near-copies by exact Jaccard similarity of word shingles; candidates from SimHash links and MinHash bands.

1. A class is a set of shingles; texts with the same set are copies and go on as one.
2. Candidates: the links of operator 4's trie self-join over fingerprints of the same shingles, and bands. Two sets of similarity
   0.8 differ in 10 of 64 bits, give or take 3, and a trie can't prune at 20 bits; so each class also has BANDS keys of ROWS
   minima each. Two classes of similarity j share a key with probability 1 - (1 - j**ROWS)**BANDS: 0.99998 at 0.8, more above.
3. Classes that share a key are compared by their whole sets: first each with the smallest class of its key. After
   components are taken, keys that still hold several go to tasks, in pairs of chunks of at most CHUNK classes with their sets.
   A task compares its classes, but for pairs in one component, and returns a link for each two components that meet.
   So every pair that shares a key is compared or already connected, a large group of near-copies costs one
   comparison a member, and no row is made for a pair.

Defined results: null and wordless texts have no shingles and are copies of each other; a text of fewer words than a shingle
is one shingle; white space and the case of ASCII letters do not count; an empty table gives an empty one; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm import simhash
from streamloom.llm.common import discard, likely, materialize
from streamloom.llm.components import components

BANDS, ROWS = 36, 6
#: Bits in which the fingerprints of candidates may differ.
BUDGET = 2
#: Classes of a key that one task compares with as many others, about.
CHUNK = 512
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """The keys of a set of shingles by band, as signed numbers; none of an empty set."""
    if not len(found):
        return []
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        mixed = found[None, at : at + 1024] * _ODD[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)]


def _signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """key, set_id (a hash of the whole set), fp (the SimHash of the set) and bands of every row (key long, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column(1)]
            ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(fps), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], names=["key", "set_id", "fp", "bands"])

    return rows.select("key", "text").mapInArrow(run, "key long, set_id binary, fp long, bands array<long>")


def _sets(rows: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """key and found, the whole set, of the rows with those keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), shingle).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "found"])

    maybe, _ = likely(rows.select("key", "text"), F.col("key"), keys.select("key"))
    return materialize(maybe.join(keys, "key", "left_semi").mapInArrow(run, "key long, found array<long>"), "near-sets")


def _alike(pairs: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of pairs (u, v) whose sets have at least that similarity."""
    pairs = materialize(pairs.distinct(), "near-pairs")
    sets = _sets(rows, pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), shingle)
    both = pairs.join(sets.select(F.col("key").alias("u"), F.col("found").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("found").alias("b")), "v")
    both = both.withColumn("n", F.size(F.array_intersect("a", "b")))
    links = materialize(both.where(F.col("n") >= F.lit(least) * (F.size("a") + F.size("b") - F.col("n")) - 1e-9).select("u", "v"), "near-links")
    discard(sets)
    discard(pairs)
    return links


def meetings(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between classes of different labels with at least that similarity; one for each class and other label."""
    kinds, of, n = np.unique(labels, return_inverse=True, return_counts=True)
    if len(kinds) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    # Of two classes with different labels one at least is not of the most frequent label.
    for i in np.flatnonzero(of != np.argmax(n)):
        starts, ends = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        lengths = ends - starts
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((common >= least * (sizes + sizes[i] - common) - 1e-9) & (of != of[i]))
        _, first = np.unique(of[near], return_index=True)
        out += [(int(nodes[i]), int(nodes[j])) for j in near[first]]
    return out


def _rest(members: DataFrame, rows: DataFrame, shingle: int, least: float, chunk: int) -> DataFrame:
    """Links between members (band, node, label) of a key that are in different components."""
    sizes = members.groupBy("band").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    k = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = members.join(sizes, "band").withColumn("k", k).select("band", "node", "label", "k", F.explode(F.expr("sequence(0, chunks - 1)")).alias("j"))
    dealt = dealt.select("band", F.least("k", "j").alias("i"), F.greatest("k", "j").alias("j"), "node", "label")
    sets = _sets(rows, members.select(F.col("node").alias("key")).distinct(), shingle)
    placed = dealt.join(sets.withColumnRenamed("key", "node"), "node")

    def run(table: pa.Table) -> pa.Table:
        found = meetings(table.column("node").to_numpy(), table.column("label").to_numpy(), [x.values.to_numpy() for x in table.column("found")], least)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return materialize(placed.groupBy("band", "i", "j").applyInArrow(run, "u long, v long"), "near-meetings")


def near_copies(rows: DataFrame, shingle: int = 5, least: float = 0.8, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """key, component of every row (key long, distinct and the same whenever rows is read; text): components over pairs of at
    least that similarity."""
    signed = materialize(_signatures(rows, shingle), "near-signatures")
    classes = materialize(signed.groupBy("set_id").agg(F.min("key").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-classes")
    # Classes with one fingerprint, and fingerprints that operator 4 links.
    prints = materialize(classes.groupBy("fp").agg(F.min("rep").alias("first")), "near-prints")
    same = classes.join(prints, "fp").where("first <> rep").select(F.col("first").alias("u"), F.col("rep").alias("v"))
    stars = materialize(simhash.links(prints.select("fp"), budget), "near-stars")
    ends = stars.join(prints.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    bits = same.unionByName(ends.select(F.col("a").alias("u"), F.col("b").alias("v")))
    keyed = classes.select(F.col("rep").alias("node"), F.explode("bands").alias("band"))
    first = keyed.groupBy("band").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1").select("band", "u")
    shared = materialize(keyed.join(materialize(first, "near-first"), "band"), "near-shared")
    pairs = shared.where("u <> node").select("u", F.col("node").alias("v")).unionByName(bits)
    links = _alike(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), rows, shingle, least)
    label = materialize(components(links, "near-cc"), "near-labels")
    placed = materialize(shared.join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "near-placed")
    # Pairs with the first of a key are compared already; only keys of three classes or more that are not one component are left.
    open_ = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("n > 2 AND lo <> hi").select("band")
    rest = materialize(placed.join(materialize(open_, "near-open"), "band"), "near-rest")
    label = components(links.unionByName(_rest(rest, rows, shingle, least, chunk)), "near-cc")
    of = classes.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("set_id", F.coalesce("label", "rep").alias("component"))
    return signed.select("key", "set_id").join(of, "set_id").select("key", "component")
