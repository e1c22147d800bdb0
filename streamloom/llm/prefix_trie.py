"""The trie of conversation prefixes: what conversations share from their first turn on.

Turns are reduced to two 64-bit hashes and a length where they are read; no text is shuffled. Conversations are dealt to ranges of
(conversation, place), so that one of any length is many tasks; a prefix is known by two polynomials of its turns' hashes modulo
2**64, which are summed up in a range and carried on from the ranges before. Equal prefixes are counted before they meet.

Runs of nodes that the same conversations go through are one chain, of which there are at most twice as many as conversations.
Chains are dealt to shards by prefix: below each chain with more than `members` conversations, every branch with no more is a
shard. In a task numpy orders a few shards, a forest, by levels as a LOUDS bit vector with an array of labels, and adds up leaves and savings in reverse
breadth-first order. What remains, the heavy upper levels, takes the totals of the shards and is merged in the same way with
`members` squared, cubed and so on, until the root is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import discard, materialize

#: A conversation begins with fewer than SHARE turns of the first one of its GROUP.
SHARE, GROUP = 6, 100

#: Most conversations of a shard on the first level, and chains that a task takes at a time: the shards of a hash, which are few.
MEMBERS, CHAINS = 256, 1024

#: Odd multipliers of the two polynomials (fixed values, 64 random bits each).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

KEY = ["d", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def elements(turns: DataFrame) -> DataFrame:
    """Turns of conversations that have an id: conv, turn, role, two hashes of role and text, and the code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"),
        F.xxhash64(role, text).alias("e1"), F.xxhash64(F.lit(1), text, role).alias("e2"), F.length(text).cast("long").alias("chars"),
    )


def _runs(ids: np.ndarray, last: int | None) -> np.ndarray:
    """Where each row's run of equal ids begins; -1 in a first run that goes on from an id before."""
    starts = np.zeros(len(ids), np.int64)
    starts[1:] = np.where(ids[1:] != ids[:-1], np.arange(1, len(ids)), 0)
    starts = np.maximum.accumulate(starts)
    return np.where((starts == 0) & (ids[:1] == last if last is not None else False), -1, starts)


def _carried(rows: DataFrame, sums: list[str]) -> dict[int, tuple]:
    """Of ranges in order: what the conversation that a range begins with has in the ranges before, in so many columns that are
    running totals, if anything; and whether its last conversation goes on. One row a range comes to the driver."""
    tail = F.max(F.struct("conv", "place", *sums)).alias("tail")
    found = sorted(rows.groupBy("part").agg(F.min("conv").alias("first"), tail).collect(), key=lambda r: r["part"])
    out, last, so_far = {}, None, ()
    for k, r in enumerate(found):
        begun = so_far if r["first"] == last else (0,) * (1 + len(sums))
        more = k + 1 < len(found) and found[k + 1]["first"] == r["tail"]["conv"]
        out[r["part"]] = (r["first"], *begun, r["tail"]["conv"], more)
        here = (r["tail"]["place"] + 1, *(r["tail"][s] for s in sums))
        if r["tail"]["conv"] == r["first"]:
            here = _onward(begun, here)
        last, so_far = r["tail"]["conv"], here
    return out


def _onward(before: tuple, here: tuple) -> tuple:
    """Totals after a piece that follows another: places and lengths add up, polynomials shift."""
    n = before[0]
    if len(here) == 1:
        return (n + here[0],)
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    return (n + here[0], *(wrap(before[1 + i] + pow(b, n, 2**64) * here[1 + i]) for i, b in enumerate(BASES)), before[3] + here[3])


def places(turns: DataFrame) -> DataFrame:
    """elements() with each turn's place in its conversation, by turn, nulls first, then role and hashes."""
    order = ["conv", "turn", "role", "e1", "e2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if b.num_rows:
                conv = b.column("conv").to_numpy()
                starts = _runs(conv, last)
                place = np.arange(len(conv)) - starts + np.where(starts < 0, seen - 1, 0)
                last, seen = conv[-1], place[-1] + 1
                yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(place), *(b.column(c) for c in ("e1", "e2", "chars")), pa.array(np.full(len(conv), part, np.int32))], names=["conv", "place", "e1", "e2", "chars", "part"])

    dealt = elements(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(dealt.mapInArrow(run, "conv long, place long, e1 long, e2 long, chars long, part int"), "turn-places")
    starts = [(part, c[0], c[1]) for part, c in _carried(rows, []).items()]
    table = rows.sparkSession.createDataFrame(starts, "part int, first long, before long")
    place = F.col("place") + F.when(F.col("conv") == F.col("first"), F.col("before")).otherwise(0)
    return rows.join(F.broadcast(table), "part").select("conv", place.alias("place"), "e1", "e2", "chars")


def rebuilt(placed: DataFrame, share: int = SHARE, group: int = GROUP) -> DataFrame:
    """(conv, origin, at, e1, e2, chars): a start row of each conversation (origin 0), the first h turns of the first conversation of
    its group (1), its own turns but its first h (2), with h = crc32 of its id modulo share."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % share
    hashes = ["e1", "e2", "chars"]
    zero = F.lit(0).cast("long")
    convs = placed.where("place = 0").select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    heads = placed.where((F.col("place") < share - 1) & (F.col("conv") % group == 0)).select(F.col("conv").alias("head"), "place", *hashes)
    given = convs.join(heads, (F.col("base") == F.col("head")) & (F.col("place") < F.col("h")))
    start = convs.select("conv", F.lit(0).alias("origin"), zero.alias("at"), *(zero.alias(c) for c in hashes))
    own = placed.where(F.col("place") >= h).select("conv", F.lit(2).alias("origin"), F.col("place").alias("at"), *hashes)
    return start.unionByName(given.select("conv", F.lit(1).alias("origin"), F.col("place").alias("at"), *hashes)).unionByName(own)


def _power(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2**64."""
    out, factor, left = np.ones(len(n), np.uint64), np.uint64(base), n.astype(np.uint64)
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & np.uint64(1), out * factor, out)
            factor, left = factor * factor, left >> np.uint64(1)
    return out


def paths(sequences: DataFrame) -> DataFrame:
    """A row for each prefix of each sequence of rebuilt(): conv, its depth d and key p1, p2, the parent's q1, q2, the hashes and
    length of its last turn, the length of all its turns (total), and whether it is the whole sequence (ends)."""
    order = ["conv", "origin", "at"]
    longs = ["conv", "place", "p1", "p2", "total", "q1", "q2", "e1", "e2", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, (0, np.uint64(0), np.uint64(0), 0)
        held: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv").to_numpy()
            starts = _runs(conv, last)
            first, goes_on = np.maximum(starts, 0), starts < 0
            place = np.arange(len(conv)) - first + np.where(goes_on, seen[0], 0)
            sums = []
            for base, e, before in ((BASES[0], "e1", seen[1]), (BASES[1], "e2", seen[2])):
                x = b.column(e).to_numpy().view(np.uint64) * _power(base, place)
                run_sums = np.cumsum(x, dtype=np.uint64)
                p = run_sums - (run_sums[first] - x[first]) + np.where(goes_on, before, np.uint64(0))
                sums.append((p, p - x))
            chars = b.column("chars").to_numpy()
            cum = np.cumsum(chars)
            total = cum - (cum[first] - chars[first]) + np.where(goes_on, seen[3], 0)
            (p1, q1), (p2, q2) = sums
            last, seen = conv[-1], (place[-1] + 1, p1[-1], p2[-1], total[-1])
            ends = np.append(conv[1:] != conv[:-1], False)
            columns = [conv, place, *(x.view(np.int64) for x in (p1, p2)), total, *(x.view(np.int64) for x in (q1, q2)), *(b.column(c).to_numpy() for c in ("e1", "e2", "chars"))]
            made = pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.array(ends), pa.array(np.full(len(conv), part, np.int32))], names=[*longs, "ends", "part"])
            if held is not None:
                yield _closed(held, held.column("conv")[0].as_py() != int(conv[0]))
            if len(conv) > 1:
                yield made.slice(0, len(conv) - 1)
            held = made.slice(len(conv) - 1)
        if held is not None:
            yield _closed(held, True)

    dealt = sequences.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = ", ".join(f"{c} long" for c in longs)
    rows = materialize(dealt.mapInArrow(run, f"{fields}, ends boolean, part int"), "prefix-pieces")
    carried = {part: c for part, c in _carried(rows, ["p1", "p2", "total"]).items() if c[1] or c[-1]}

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: b.column(c).to_numpy(zero_copy_only=False).copy() for c in [*longs, "ends"]}
            for part in np.unique(b.column("part").to_numpy()):
                if part not in carried:
                    continue
                first, n, c1, c2, total, last, more = carried[part]
                here = b.column("part").to_numpy() == part
                mine = here & (at["conv"] == first)
                if n:
                    for base, before, names in ((BASES[0], c1, ("p1", "q1")), (BASES[1], c2, ("p2", "q2"))):
                        for name in names:
                            shifted = at[name].view(np.uint64)[mine] * np.uint64(pow(base, n, 2**64)) + np.array([before], np.int64).view(np.uint64)
                            at[name][mine] = shifted.view(np.int64)
                    at["place"][mine] += n
                    at["total"][mine] += total
                if more:
                    at["ends"][here & (at["conv"] == last)] = False
            yield pa.RecordBatch.from_arrays([pa.array(at[c]) for c in [*longs, "ends"]], names=[*longs, "ends"])

    found = materialize(rows.mapInArrow(onward, f"{fields}, ends boolean").withColumnRenamed("place", "d"), "prefixes")
    discard(rows)
    return found


def _closed(row: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
    return row.set_column(row.schema.get_field_index("ends"), "ends", pa.array([ends]))


def ends_digest(ends: DataFrame) -> DataFrame:
    """For each key the sha256 of its conversations' ids, ascending and joined by commas. Ids are sorted by ranges and joined in
    pieces; a key's pieces are hashed one after the other, so that no list of ids is ever whole."""
    order = [*KEY, "conv"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.stack([b.column(c).to_numpy() for c in KEY])
                conv = b.column("conv").to_numpy()
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
                texts = [",".join(map(str, conv[i:j].tolist())).encode() for i, j in zip(cuts, [*cuts[1:], len(conv)], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(k[cuts]) for k in keys), pa.array(conv[cuts]), pa.array(texts, pa.binary())], names=[*order, "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, so_far = None, None
        for b in batches:
            out = []
            for *now, ids in zip(*(b.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
                if now == key:
                    so_far.update(b",")
                    so_far.update(ids)
                else:
                    if key is not None:
                        out.append((*key, so_far.hexdigest()))
                    key, so_far = now, hashlib.sha256(ids)
            yield _digests(out)
        if key is not None:
            yield _digests([(*key, so_far.hexdigest())])

    listed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "d long, p1 long, p2 long, conv long, ids binary")
    return listed.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(digest, "d long, p1 long, p2 long, sha string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "sha"])


def louds(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """A forest in level order: the order of its nodes, the bit vector, and where levels begin. parent: indices, -1 for tops.

    Bits: first a super-root's, then each node's degree in ones and a zero."""
    m = len(parent)
    by_parent = np.argsort(parent, kind="stable")
    degree = np.bincount(parent + 1, minlength=m + 1)
    first = np.concatenate([[0], np.cumsum(degree)])
    levels, level = [], by_parent[: degree[0]]
    while len(level):
        levels.append(level)
        n = degree[level + 1]
        at = np.repeat(first[level + 1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        level = by_parent[at]
    order = np.concatenate(levels) if levels else np.zeros(0, np.int64)
    bits = np.ones(2 * m + 1, np.uint8)
    bits[np.cumsum(np.concatenate([degree[:1], degree[order + 1]]) + 1) - 1] = 0
    return order, bits, np.cumsum([0, *(len(x) for x in levels)]).tolist()


def parents_of(bits: np.ndarray) -> np.ndarray:
    """The parent of each node in level order, -1 for tops: node i is the i-th one, and as many zeros lie before it as there are
    nodes up to its parent."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones)) - 1


def _rollup(table: pa.Table) -> pa.Table:
    """Leaves and savings of whole subtrees, of the chains of some shards."""
    conv, n, pconv, pn, leaves, saved = (table.column(c).to_numpy() for c in ("conv", "n", "pconv", "pn", "leaves", "saved"))
    m = len(conv)
    keys, at = np.unique(np.concatenate([np.stack([conv, n], 1), np.stack([pconv, pn], 1)]), axis=0, return_inverse=True)
    number = np.full(len(keys), -1)
    number[at.ravel()[:m]] = np.arange(m)
    order, bits, starts = louds(number[at.ravel()[m:]])
    parent = parents_of(bits)
    leaves, saved = leaves[order].copy(), saved[order].copy()
    for k in range(len(starts) - 2, 0, -1):
        lo, hi = starts[k], starts[k + 1]
        np.add.at(leaves, parent[lo:hi], leaves[lo:hi])
        np.add.at(saved, parent[lo:hi], saved[lo:hi])
    return pa.table({"conv": conv[order], "n": n[order], "pconv": pconv[order], "pn": pn[order], "leaves": leaves, "saved": saved, "top": parent < 0})


def _totals(chains: DataFrame, found: DataFrame, members: int) -> DataFrame:
    """(conv, n, leaves, saved) of the subtrees of all chains (conv, n, pconv, pn, tail key, leaves and saved of their own)."""
    schema = "conv long, n long, pconv long, pn long, leaves long, saved long, top boolean"
    most, n_chains = chains.agg(F.max("n"), F.count("*")).first()
    most, groups = most or 0, max(1, n_chains // CHAINS)
    done, open_, limit = [], chains, members
    while True:
        if most <= limit:
            shards = open_.groupBy(F.lit(0).alias("s0"))
        else:
            tails = open_.where(F.col("n") > limit).select(F.col("tail_d").alias("a"), F.col("tail_1").alias("b"), F.col("tail_2").alias("c"))
            below = found.where("d > 0").join(tails, (F.col("d") - 1 == F.col("a")) & (F.col("q1") == F.col("b")) & (F.col("q2") == F.col("c")))
            tops = below.groupBy("conv").agg(F.max("d").alias("s0"), F.max_by("p1", "d").alias("s1"), F.max_by("p2", "d").alias("s2"))
            shards = open_.where(F.col("n") <= limit).join(tops.withColumnRenamed("conv", "of"), F.col("conv") == F.col("of")).groupBy(F.pmod(F.xxhash64("s0", "s1", "s2"), F.lit(groups)).alias("shards"))
        rolled = materialize(shards.applyInArrow(_rollup, schema), "shards")
        done.append(rolled.select("conv", "n", "leaves", "saved"))
        if most <= limit:
            break
        more = rolled.where("top").groupBy(F.col("pconv").alias("c"), F.col("pn").alias("m")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        left = open_.where(F.col("n") > limit).join(more, (F.col("conv") == F.col("c")) & (F.col("n") == F.col("m")), "left")
        columns = {"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}
        open_ = materialize(left.withColumns(columns).drop("c", "m", "l", "s"), "heavy-chains")
        limit *= members
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def trie(sequences: DataFrame, members: int = MEMBERS) -> DataFrame:
    """The nodes of the trie of sequences (as of rebuilt()): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and e1, e2, the hashes of the last turn, by which with_texts() finds it (0, 0 at the root)."""
    found = paths(sequences)
    constant = ["q1", "q2", "e1", "e2", "chars", "total"]
    nodes = materialize(found.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv").alias("conv"), *(F.first(c).alias(c) for c in constant)), "nodes")
    chains = nodes.groupBy("conv", "n").agg(
        F.min("d").alias("head_d"), F.min_by("q1", "d").alias("head_1"), F.min_by("q2", "d").alias("head_2"), F.min_by(F.col("total") - F.col("chars"), "d").alias("before"),
        F.max("d").alias("tail_d"), F.max_by("p1", "d").alias("tail_1"), F.max_by("p2", "d").alias("tail_2"), F.max("total").alias("whole"),
    )
    chains = materialize(chains, "chains")
    up = chains.select(F.col("tail_d").alias("a"), F.col("tail_1").alias("b"), F.col("tail_2").alias("c"), F.col("conv").alias("pconv"), F.col("n").alias("pn"))
    tree = materialize(chains.join(up, (F.col("head_d") - 1 == F.col("a")) & (F.col("head_1") == F.col("b")) & (F.col("head_2") == F.col("c")), "left").drop("a", "b", "c"), "chain-tree")
    children = tree.where("pn IS NOT NULL").groupBy(F.col("pconv").alias("k"), F.col("pn").alias("kn")).agg(F.count("*").alias("children"))
    full = materialize(tree.join(children, (F.col("conv") == F.col("k")) & (F.col("n") == F.col("kn")), "left").drop("k", "kn"), "chain-children")
    own = full.select(
        "conv", "n", F.coalesce("pconv", F.lit(0)).alias("pconv"), F.coalesce("pn", F.lit(-1)).alias("pn"), "tail_d", "tail_1", "tail_2",
        F.col("children").isNull().cast("long").alias("leaves"), ((F.col("n") - 1) * (F.col("whole") - F.col("before"))).alias("saved"),
    )
    totals = _totals(own, found, members).select(F.col("conv").alias("k"), F.col("n").alias("kn"), "leaves", "saved")
    digests = ends_digest(found.where("ends")).select(F.col("d").alias("a"), F.col("p1").alias("b"), F.col("p2").alias("c"), "sha")
    about = full.join(totals, (F.col("conv") == F.col("k")) & (F.col("n") == F.col("kn"))).drop("k", "kn")
    about = about.join(digests, (F.col("tail_d") == F.col("a")) & (F.col("tail_1") == F.col("b")) & (F.col("tail_2") == F.col("c")), "left")
    about = materialize(about.select(F.col("conv").alias("k"), F.col("n").alias("kn"), "head_d", "tail_d", "before", "pconv", "children", "leaves", F.col("saved").alias("all_saved"), "sha"), "chains-done")
    tail = F.col("d") == F.col("tail_d")
    out = nodes.join(about, (F.col("conv") == F.col("k")) & (F.col("n") == F.col("kn")))
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("head_d"), F.col("pconv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(tail, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("all_saved") - (F.col("n") - 1) * (F.col("total") - F.col("chars") - F.col("before"))).alias("saved_tokens"),
        F.when(tail, F.coalesce("sha", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"), "e1", "e2",
    )


def prefix_trie(turns: DataFrame, members: int = MEMBERS) -> DataFrame:
    """trie() of the conversations (conv_id, turn, role, text), each with the first turns of its group's first one (see rebuilt()).

    Defined results: a null role or text is an empty one; null turns come first, equal ones in the order of role and of the text's
    hashes; rows without a conv_id belong to no conversation; repeated rows are turns each; other columns are not read. A conversation
    without turns left is a member of the root. An empty table gives an empty one. Texts are whole, of any length."""
    return trie(rebuilt(places(turns)), members)


def with_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes of trie() with role and text of their last turn instead of hashes; null at the root."""
    texts = turns.select(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    labels = texts.select(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), "role", "text").dropDuplicates(["a", "b"])
    return nodes.join(labels, (F.col("e1") == F.col("a")) & (F.col("e2") == F.col("b")) & (F.col("depth") > 0), "left").drop("a", "b", "e1", "e2")


#: crc32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(z) + 1), lambda i: CAST(ascii(z[CAST(i AS INTEGER)]) AS BIGINT))), lambda a, b:
  list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % {SHARE} AS h, conv_id - conv_id % {GROUP} AS base FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS z FROM t)),
r AS (SELECT c.conv_id, 0 AS o, i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o, i) AS d, md5(role || chr(0) || text) AS e, length(text) AS n FROM r),
p AS MATERIALIZED (SELECT conv_id, 0 AS d, '' AS k, '' AS up, 0 AS n FROM c UNION ALL
  SELECT conv_id, d, md5(string_agg(e, '') OVER w) AS k, CASE WHEN d > 1 THEN md5(string_agg(e, '') OVER v) ELSE '' END, n FROM x
  WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
top AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
nodes AS MATERIALIZED (SELECT p.d, k, any_value(up) AS up, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
  sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE top.d = p.d), '')) AS ends_sha256 FROM p JOIN top ON top.conv_id = p.conv_id GROUP BY p.d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
pairs AS (SELECT DISTINCT a.d AS ad, a.k AS ak, b.d, b.k FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.d >= a.d),
sums AS (SELECT ad AS d, ak AS k, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((n_convs - 1) * n) AS saved FROM pairs JOIN nodes USING (d, k) LEFT JOIN kids USING (d, k) GROUP BY ALL)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, coalesce(kids.n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM nodes a JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN nodes b ON b.d = a.d - 1 AND b.k = a.up
"""
