"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

1. A fingerprint of 64 bits per document, from the XXH64 of its word shingles (in tasks, numpy).
2. Distinct fingerprints are the leaves of binary tries, one for each of budget + 1 blocks of bits, which is turned to the top. Of two
   fingerprints within the budget one block is equal, so in one trie they are below the same node of its upper levels, and nodes
   meet themselves there: each fingerprint goes to as many tables of nodes as there are blocks, however many fingerprints there are.
   Crowded nodes are taken six levels further down as pairs of nodes, of which those survive whose prefixes differ in no more bits
   than the error budget, until each pair fits a task.
3. Each task walks the pairs of nodes below its pair together, bit by bit, adds up differing bits and drops a pair
   as soon as they exceed the budget. What is left are the links; a task returns a spanning star of each local component.
4. Components of the stars, by contraction (components.py).

Defined results: null and wordless texts have fingerprint zero and are linked like any other; a text of fewer words
than a shingle is one shingle; repeated rows come back as often as they came in; component_id is the smallest non-null
id reachable, null if there is none; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import discard, materialize
from streamloom.llm.components import components

BITS = 64
#: Most fingerprints that one task compares at once; a pair of subtrees that holds more is split.
PAIR_ROWS = 16_384
#: Most node pairs on a task's frontier.
FRONTIER = 1 << 19
#: Pairs of ranges with at most so many combinations are compared leaf by leaf.
LEAF = 8


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (uint64), as an unsigned number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[at : at + 8192])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one text, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def local_components(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest node reachable from each of n nodes over edges (u, v), going on from earlier labels."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, again := label[label]):
            label = again


def trie_pairs(left: np.ndarray, right: np.ndarray, same: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of distinct uint64 (one array joined with itself if same) that differ in at most
    budget bits. Nodes are ranges of the arrays; pairs of nodes go down together, one bit at a time."""
    if not len(left) or not len(right):
        return
    one = np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)]), np.array([0]), np.array([same])
    stack = [(BITS - 1, one)]
    while stack:
        bit, (alo, ahi, blo, bhi, d, own) = stack.pop()
        na, nb = ahi - alo, bhi - blo
        done = na * nb <= LEAF if bit >= 0 else np.ones(len(d), bool)
        if done.any():
            a0, b0, m, w, o = alo[done], blo[done], (na * nb)[done], nb[done], own[done]
            at = np.repeat(np.arange(len(m)), m)
            k = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            i, j = a0[at] + k // w[at], b0[at] + k % w[at]
            near = (np.bitwise_count(left[i] ^ right[j]) <= budget) & ~(o[at] & (i >= j))
            yield i[near], j[near]
            rest = ~done
            alo, ahi, blo, bhi, d, own = (x[rest] for x in (alo, ahi, blo, bhi, d, own))
        if not len(d):
            continue
        if len(d) > FRONTIER:
            half = len(d) // 2
            stack += [(bit, tuple(x[:half] for x in (alo, ahi, blo, bhi, d, own))), (bit, tuple(x[half:] for x in (alo, ahi, blo, bhi, d, own)))]
            continue
        t, first = np.uint64(bit), np.uint64(1)
        amid = np.clip(np.searchsorted(left, ((left[alo] >> t) | first) << t), alo, ahi)
        bmid = np.clip(np.searchsorted(right, ((right[blo] >> t) | first) << t), blo, bhi)
        children = (
            (alo, amid, blo, bmid, d, own, None),
            (amid, ahi, bmid, bhi, d, own, None),
            (alo, amid, bmid, bhi, d + 1, np.zeros_like(own), None),
            (amid, ahi, blo, bmid, d + 1, np.zeros_like(own), own),
        )
        kept = []
        for x0, x1, y0, y1, e, o, twice in children:
            keep = (x1 > x0) & (y1 > y0) & (e <= budget)
            if twice is not None:  # of a node with itself the two mixed pairs of children are one
                keep &= ~twice
            kept.append(tuple(z[keep] for z in (x0, x1, y0, y1, e, o)))
        stack.append((bit - 1, tuple(np.concatenate(z) for z in zip(*kept, strict=True))))


def _stars(fps: np.ndarray, top: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the components among fps; top tells which of the two subtrees each is in."""
    order = np.argsort(fps)
    fps, top = fps[order], top[order]
    same = bool(top.all() or not top.any())
    where = (np.arange(len(fps)),) * 2 if same else (np.flatnonzero(~top), np.flatnonzero(top))
    label = np.arange(len(fps))
    for i, j in trie_pairs(fps[where[0]], fps[where[1]], same, budget):
        label = local_components(len(fps), where[0][i], where[1][j], label)
    far = np.flatnonzero(label != np.arange(len(fps)))
    return fps[far], fps[label[far]]


def _masks(bits: int, budget: int) -> list[int]:
    found = {0}
    for _ in range(budget):
        found |= {m ^ (1 << k) for m in found for k in range(bits)}
    return sorted(m for m in found if m.bit_count() <= budget)


def node_pairs(fps: DataFrame, budget: int = 2, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Rows (turn, pa, pb, depth, fp): every fingerprint, turned left by so many bits, with each pair of nodes of that trie that it takes
    part in."""
    n, width = fps.count(), BITS // (budget + 1)
    depth = min(width, 24, max(6, math.ceil(math.log2(max(1, n) / (pair_rows / 4)))))

    def prefix(bits: int):
        return F.shiftrightunsigned("fp", BITS - bits)

    turned = [F.struct(F.lit(k * width).alias("turn"), F.shiftleft("fp", k * width).bitwiseOR(F.shiftrightunsigned("fp", BITS - k * width) if k else F.lit(0).cast("long")).alias("fp")) for k in range(budget + 1)]
    rows = fps.select(F.explode(F.array(*turned)).alias("t")).select("t.turn", "t.fp").select("turn", prefix(depth).alias("pa"), prefix(depth).alias("pb"), F.lit(depth).alias("depth"), "fp")
    node, out = ["turn", "pa", "pb"], None
    while True:
        above = F.expr("shiftrightunsigned(fp, 64 - depth) = pb AND pa <> pb").cast("int")
        sizes = rows.groupBy(*node).agg(F.count("*").alias("n"), F.sum(above).alias("n_top")).where(F.col("n") > pair_rows)
        big = materialize(sizes.select(*node, F.expr("pa = pb OR n_top BETWEEN 1 AND n - 1").alias("met")), "simhash-crowded")
        if depth >= BITS - 6 or big.isEmpty():
            return rows if out is None else out.unionByName(rows)
        small = rows.join(big.select(*node), node, "left_anti")
        out = small if out is None else out.unionByName(small)
        lower = F.array(*(F.lit(m).cast("long") for m in _masks(6, budget)))
        crowded = materialize(rows.join(big.where("met").select(*node), node, "left_semi"), "simhash-rows")
        other = F.shiftleft(F.col("pa").bitwiseXOR(F.col("pb")), 6)
        rows = (
            crowded.select("turn", "fp", other.alias("o"), F.explode(lower).alias("m"))
            .where(F.bit_count("o") + F.bit_count("m") <= budget)
            .select("turn", "fp", prefix(depth + 6).alias("p"), F.col("o").bitwiseOR(F.col("m")).alias("x"))
            .select("turn", F.least("p", F.col("p").bitwiseXOR(F.col("x"))).alias("pa"), F.greatest("p", F.col("p").bitwiseXOR(F.col("x"))).alias("pb"), F.lit(depth + 6).alias("depth"), "fp")
        )
        depth += 6


def links(fps: DataFrame, budget: int = 2, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(u, v): stars that span the components of distinct fingerprints (fp long) within budget bits."""
    rows = node_pairs(fps, budget, pair_rows).withColumn("top", (F.expr("shiftrightunsigned(fp, 64 - depth)") == F.col("pb")) & (F.col("pa") != F.col("pb")))

    def run(table: pa.Table) -> pa.Table:
        u, v = _stars(table.column("fp").to_numpy().view(np.uint64), table.column("top").to_numpy(), budget)
        back = np.uint64(table.column("turn")[0].as_py())
        if back:
            u, v = ((x >> back) | (x << (np.uint64(BITS) - back)) for x in (u, v))
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return rows.groupBy("turn", "pa", "pb", "depth").applyInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2, seed: int = 42, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    prints = materialize(with_fingerprint(docs, id_col, text_col, shingle, seed), "simhash-fp")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    stars = materialize(links(classes.select("fp"), budget, pair_rows), "simhash-stars")
    labels = materialize(components(stars, "simhash-cc"), "simhash-labels")
    discard(stars)
    heads = labels.join(classes.withColumnRenamed("fp", "node"), "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    heads = materialize(heads, "simhash-heads")
    linked = labels.join(heads, "label").select(F.col("node").alias("fp"), "component_id")
    of = materialize(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "simhash-of")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
