"""Repeated passages: removal of every byte that a string of `size` bytes covers which also starts anywhere else.

1. Anchors. Every window of `size` bytes has a smallest k-gram by hash, the leftmost of equals; neighbouring windows with the
   same one form a fragment. Equal windows have equal anchors at equal offsets, so they can only meet among fragments of one
   anchor, aligned at it. Fragments go by anchor; one that occurs alone has no repeated window, and equal ones are
   repeated as a whole. Only fragments of an anchor that differ from each other are looked into.
2. Column-wise construction. The collection of such fragments is built up from the right, one symbol of each fragment a
   round. A round re-sorts the order of suffixes by the new symbol, stably, which is the collection's (positional)
   Burrows-Wheeler step, and updates the common prefixes of neighbours by minima over the spans between them. A window is
   repeated where the common prefix with a neighbour reaches `size`.
3. Crowded anchors are split without loss: windows at nearby offsets share a core of bytes, so fragments are dealt again by
   offset range and a hash of the core, in ever smaller ranges until no group holds too many. Ranges of one offset have
   one content each.
4. Repeated windows are united within each document.
5. Passages of over 50 words may have fewer bytes than `size`. Beside what is removed, documents are told how many of their word
   grams, chosen by local minima, a different text also has; nothing is removed for that.

Buckets of fragments are bounded, so that the columns stay in a task's memory instead of external files.
Keys are hashes: 64 bits of anchor and of content together, 128 bits for texts.

Defined results: a null text is empty; texts shorter than `size` lose nothing; repeated rows are copies of each other, and
from `size` bytes on lose everything; null ids are kept; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import discard, likely, materialize

SIZE = 400
GRAM = 32
#: Windows of one text that are looked at at once.
BLOCK = 1 << 20
#: Fragments that one bucket holds, about, and most of one anchor before it is split.
BUCKET = 2048
CROWDED = 1024
#: Widths of offset ranges, from fragments as they are to single offsets.
WIDTHS = (0, 48, 6, 1)

#: Words of a gram, neighbouring grams of which the least is chosen, and different words of a passage's gram: any two texts with a run of
#: over 50 words in common have a gram in common.
PASSAGE_GRAM, PASSAGE_SPAN, PASSAGE_WORDS = 24, 28, 10

_SEED = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64)) ^ (np.arange(256, dtype=np.uint64) << np.uint64(40))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling."""
    h, n = _SEED[b], 1
    while n < GRAM:
        h = h[:-n] * np.uint64(0xD6E8FEB86659FD93 + 2 * n) + h[n:]
        h ^= h >> np.uint64(31)
        n *= 2
    return h * np.uint64(0xFF51AFD7ED558CCD)


def fragments(data: bytes, size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(start, end, anchor position, anchor hash, content hash) of the fragments of a text."""
    out = []
    b = np.frombuffer(data, np.uint8)
    for at in range(0, len(b) - size + 1, BLOCK):
        part = b[at : at + BLOCK + size - 1]
        h = gram_hashes(part)
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        w, n, span = size - GRAM + 1, len(part) - size + 1, 1
        while 2 * span <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[w - span : w - span + n])
        where = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(where[1:] != where[:-1]) + 1
        starts = np.concatenate(([0], cuts))
        ends = np.concatenate((cuts, [n])) + size - 1
        keys = h.view(np.int64)[where[starts]]
        for s, e, p, k in zip((starts + at).tolist(), (ends + at).tolist(), (where[starts] + at).tolist(), keys.tolist(), strict=True):
            out.append((s, e, p, k, xxhash.xxh3_64_intdigest(data[s:e], p - s) - (1 << 63)))
    return out


def repeated_columns(strings: list[bytes], offsets: np.ndarray, groups: np.ndarray, copies: np.ndarray, low: np.ndarray, high: np.ndarray, size: int = SIZE) -> np.ndarray:
    """flags[j, c]: the window of string j that starts at column c + min(offsets) is repeated. String j starts at column
    offsets[j]; only windows from low[j] to high[j] are asked for; a string with copies is repeated itself."""
    m, base = len(strings), int(offsets.min())
    lengths = np.array([len(s) for s in strings])
    first = offsets - base
    last = first + lengths
    width = int(last.max())
    symbols = np.zeros((width, m), np.int64)
    for j, s in enumerate(strings):
        symbols[first[j] : last[j], j] = np.frombuffer(s, np.uint8)
    flags = np.zeros((m, width), bool)
    order, common = np.empty(0, np.int64), np.empty(0, np.int64)
    entering = np.argsort(groups, kind="stable")
    for c in range(width - 1, -1, -1):
        gone = first[order] > c
        if gone.any():
            stay = np.flatnonzero(~gone)
            if len(stay):
                # The common prefix of two that become neighbours is the least between them.
                spans = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate(([0], stay[:-1] + 1)))
                order, common = order[stay], spans
            else:
                order, common = order[:0], common[:0]
        new = entering[last[entering] == c + 1]
        if len(new):
            order, common = np.concatenate((new, order)), np.concatenate((np.zeros(len(new), np.int64), common))
        if not len(order):
            continue
        key = groups[order] * 256 + symbols[c, order]
        if len(new) or (key[1:] < key[:-1]).any():
            to = np.argsort(key, kind="stable")
        else:
            to = np.arange(len(order))
        key = key[to]
        same = np.concatenate(([False], key[1:] == key[:-1]))
        prefix = np.zeros(len(to), np.int64)
        near = same & np.concatenate(([False], to[1:] == to[:-1] + 1))
        prefix[near] = common[to[near]] + 1
        far = np.flatnonzero(same & ~near)
        if len(far):
            ends = np.stack([to[far - 1] + 1, to[far] + 1], axis=1).ravel()
            padded = np.append(common, 0)
            prefix[far] = np.minimum.reduceat(padded, ends)[::2] + 1
        order, common = order[to], prefix
        hit = common >= size
        hit[:-1] |= common[1:] >= size
        asked = (low[order] <= c + base) & (c + base <= high[order])
        flags[order[asked & (hit | (copies[order] > 1))], c] = True
    return flags


def passage_grams(data: bytes) -> np.ndarray:
    """Hashes of the PASSAGE_GRAM-word grams of a text that are the least among PASSAGE_SPAN neighbouring ones: two texts with a run of
    PASSAGE_GRAM + PASSAGE_SPAN - 1 words in common have one in common. Grams of few different words are left out."""
    words = data.split()
    n = len(words) - PASSAGE_GRAM - PASSAGE_SPAN + 2
    if n < 1:
        return np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    known = {w: digest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    by = {1: h}
    for size in (2, 4, 8, 16):
        half = by[size // 2]
        mixed = half[: -(size // 2)] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + half[size // 2 :]
        by[size] = mixed ^ (mixed >> np.uint64(31))
    grams = by[16][: len(words) - PASSAGE_GRAM + 1] * np.uint64(0xFF51AFD7ED558CCD) + by[8][16 : 16 + len(words) - PASSAGE_GRAM + 1]
    grams ^= grams >> np.uint64(29)
    least, span = grams, 1
    while 2 * span <= PASSAGE_SPAN:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[PASSAGE_SPAN - span : PASSAGE_SPAN - span + n])
    chosen, first = np.unique(grams, return_index=True)
    keep = np.isin(chosen, least)
    starts = first[keep]
    varied = [len(set(words[k : k + PASSAGE_GRAM])) >= PASSAGE_WORDS for k in starts.tolist()]
    return chosen[keep][np.array(varied, bool)].view(np.int64)


def shared_passages(rows: DataFrame) -> DataFrame:
    """t1, t2, n_shared of texts (t1, t2, data) that have passages in common with a different text: how many of their grams."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [passage_grams(d.as_py()) for d in b.column(2)]
            n = np.array([len(f) for f in found], np.int64)
            t1, t2 = (np.repeat(b.column(k).to_numpy(), n) for k in (0, 1))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(np.concatenate([*found, np.empty(0, np.int64)])), "t1": pa.array(t1), "t2": pa.array(t2)})

    grams = materialize(rows.select("t1", "t2", "data").mapInArrow(cut, "gram long, t1 long, t2 long"), "passages-grams")
    both = grams.groupBy("gram").agg(F.min(F.struct("t1", "t2")).alias("lo"), F.max(F.struct("t1", "t2")).alias("hi")).where("lo <> hi").select("gram")
    met = grams.join(materialize(both, "passages-shared"), "gram", "left_semi")
    # Copies of a text have its grams each: they are counted once.
    return materialize(met.groupBy("t1", "t2").agg(F.count_distinct("gram").alias("n_shared")), "passages-met")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


UNITS = "key long, unit long, content binary, off long, low long, high long"
_TYPES = {"key": pa.int64(), "unit": pa.int64(), "content": pa.binary(), "off": pa.int64(), "low": pa.int64(), "high": pa.int64()}


def _batch(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(names.items())})


def _split(units: DataFrame, width: int, size: int) -> DataFrame:
    """Units by ranges of `width` window offsets: parent_key, parent_unit and the new unit."""
    names = {"parent_key": pa.int64(), "parent_unit": pa.int64()} | _TYPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, unit, content, off, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for g in range(low // width, high // width + 1):
                    lo, hi = g * width, g * width + width - 1
                    core = content[hi - off : lo + size - off]
                    start, end = max(off, lo), min(off + len(content), hi + size)
                    cell = content[start - off : end - off]
                    to = xxhash.xxh3_64_intdigest(core, (key ^ (g * 0x9E3779B1)) & (1 << 64) - 1) - (1 << 63)
                    rows.append((key, unit, to, xxhash.xxh3_64_intdigest(cell, start & (1 << 64) - 1) - (1 << 63), cell, start, max(low, lo), min(high, hi)))
            yield _batch(rows, names)

    return units.select(*_TYPES).mapInArrow(run, f"parent_key long, parent_unit long, {UNITS}")


def _inspect(units: DataFrame, buckets: int, size: int) -> DataFrame:
    """key, unit, w_from, w_to: runs of repeated windows, by offset from the anchor."""
    names = {"key": pa.int64(), "unit": pa.int64(), "w_from": pa.int64(), "w_to": pa.int64()}

    def run(table: pa.Table) -> pa.Table:
        key, unit = table.column("key").to_numpy(), table.column("unit").to_numpy()
        off = table.column("off").to_numpy()
        _, groups = np.unique(key, return_inverse=True)
        flags = repeated_columns(table.column("content").to_pylist(), off, groups, table.column("copies").to_numpy(), table.column("low").to_numpy(), table.column("high").to_numpy(), size)
        base = int(off.min())
        rows = [(int(key[j]), int(unit[j]), a + base, z + base) for j in range(len(key)) for a, z in _runs(flags[j])]
        return pa.Table.from_batches([_batch(rows, names)])

    dealt = units.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "key long, unit long, w_from long, w_to long")


def _repeated_units(units: DataFrame, size: int, crowded: int, bucket: int) -> DataFrame:
    """key, unit, w_from, w_to of base units (with copies); level by level where a key is crowded."""
    found, links, base = None, None, units
    for level, _ in enumerate(WIDTHS):
        sizes = units.groupBy("key").agg(F.count("*").alias("n"))
        big = materialize(sizes.where(F.col("n") > crowded).select("key"), "passages-crowded") if level + 1 < len(WIDTHS) else None
        none = big is None or big.isEmpty()
        small = units if none else units.join(big, "key", "left_anti")
        total = units.count()
        runs = _inspect(small, max(1, -(-total // bucket)), size)
        if links is not None:
            runs = links.join(runs.withColumnRenamed("key", "to_key").withColumnRenamed("unit", "to_unit"), ["to_key", "to_unit"]).select("key", "unit", "w_from", "w_to")
        runs = materialize(runs, "passages-runs")
        found = runs if found is None else found.unionByName(runs)
        if none:
            return found
        cells = materialize(_split(units.join(big, "key", "left_semi"), WIDTHS[level + 1], size), "passages-cells")
        step = cells.select(F.col("parent_key").alias("to_key"), F.col("parent_unit").alias("to_unit"), F.col("key").alias("next_key"), F.col("unit").alias("next_unit"))
        before = base.select("key", "unit", F.col("key").alias("to_key"), F.col("unit").alias("to_unit")) if links is None else links
        after = before.join(step, ["to_key", "to_unit"]).select("key", "unit", F.col("next_key").alias("to_key"), F.col("next_unit").alias("to_unit"))
        copies = after.join(base.select("key", "unit", "copies"), ["key", "unit"]).groupBy("to_key", "to_unit").agg(F.sum("copies").alias("copies"))
        copies = materialize(copies.withColumnRenamed("to_key", "key").withColumnRenamed("to_unit", "unit"), "passages-copies")
        # One row of each cell's content: its rows are equal but for the windows asked for, which are united.
        one = cells.groupBy("key", "unit").agg(F.min("content").alias("content"), F.min("off").alias("off"), F.min("low").alias("low"), F.max("high").alias("high"))
        units = materialize(one.join(copies, ["key", "unit"]), "passages-units")
        links = materialize(after, "passages-links")
    return found


def _text_key(data: Column) -> list[Column]:
    return [F.xxhash64(data).alias("t1"), F.xxhash64(F.lit(7), data).alias("t2")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, crowded: int = CROWDED, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, and n_shared, the number of word grams that show a passage of
    over 50 words in common with a different text, be it shorter than `size` bytes or not."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), data.alias("data")).select("doc_id", "data", *_text_key(F.col("data")))
    frag = {"t1": pa.int64(), "t2": pa.int64(), "start": pa.int32(), "end": pa.int32(), "pos": pa.int32(), "key": pa.int64(), "unit": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t1, t2, *f) for t1, t2, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) for f in fragments(d.as_py(), size)]
            yield _batch(found, frag)

    heads = materialize(rows.select("doc_id", "t1", "t2", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha")), "passages-heads")
    texts = materialize(heads.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n_bytes")), "passages-texts")
    long = rows.where(F.octet_length("data") >= size).select("t1", "t2", "data")
    cuts = materialize(long.mapInArrow(cut, "t1 long, t2 long, start int, end int, pos int, key long, unit long"), "passages-fragments")

    contents = cuts.groupBy("key", "unit").agg(F.count("*").alias("copies"), F.min(F.struct("t1", "t2", "start", "end", "pos")).alias("at"))
    contents = materialize(contents, "passages-contents")
    anchors = materialize(contents.groupBy("key").agg(F.count("*").alias("n"), F.sum("copies").alias("total")).where("total > 1"), "passages-anchors")
    whole = contents.join(anchors.where("n = 1").select("key"), "key", "left_semi").select("key", "unit", (F.col("at.start") - F.col("at.pos")).cast("long").alias("w_from"), (F.col("at.end") - F.lit(size) - F.col("at.pos")).cast("long").alias("w_to"))
    wanted = contents.join(anchors.where("n > 1").select("key"), "key", "left_semi").select("key", "unit", "copies", "at.*")
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "unit", "copies", "start", "end", "pos")).alias("w"))
    wanted = materialize(wanted.join(texts.select("t1", "t2", "rep"), ["t1", "t2"]), "passages-wanted")
    # One row of each text is enough to read its fragments off. Of all texts only those that may have such fragments are shuffled.
    from_texts = likely(rows, F.col("t1"), wanted.select("t1"))[0].join(wanted, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("data", F.explode("w").alias("w"))
    span = F.expr("substring(data, w.start + 1, w.end - w.start)")
    units = from_texts.select("w.key", "w.unit", "w.copies", span.alias("content"), (F.col("w.start") - F.col("w.pos")).cast("long").alias("off"), (F.col("w.start") - F.col("w.pos")).cast("long").alias("low"), (F.col("w.end") - F.lit(size) - F.col("w.pos")).cast("long").alias("high"))
    units = materialize(units, "passages-units").dropDuplicates(["key", "unit"])
    runs = _repeated_units(units, size, crowded, bucket)
    runs = materialize(whole.unionByName(runs), "passages-repeated")

    single = cuts.join(texts.where("n = 1").select("t1", "t2"), ["t1", "t2"], "left_semi")
    marked = single.join(runs, ["key", "unit"]).select("t1", "t2", F.struct((F.col("pos") + F.col("w_from")).alias("a"), (F.col("pos") + F.col("w_to") + size).alias("z")).alias("r"))
    marked = materialize(marked.groupBy("t1", "t2").agg(F.collect_list("r").alias("runs")), "passages-marked")
    discard(cuts)

    def erase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t1, t2, d, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                text = d.as_py()
                gone = np.zeros(len(text) + 1, np.int64)
                for r in found:
                    gone[r["a"]] += 1
                    gone[r["z"]] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                out.append((t1, t2, int(covered.sum()), len(_runs(covered)), hashlib.sha256(kept).hexdigest()))
            yield _batch(out, {"t1": pa.int64(), "t2": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.string()})

    partly = likely(rows, F.col("t1"), marked.select("t1"))[0].join(marked, ["t1", "t2"]).select("t1", "t2", "data", "runs").mapInArrow(erase, "t1 long, t2 long, n_removed long, n_spans long, kept string")
    copied = texts.where((F.col("n") > 1) & (F.col("n_bytes") >= size)).select("t1", "t2", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    changed = materialize(partly.unionByName(copied), "passages-changed")
    zero = F.lit(0).cast("long")
    out = heads.join(changed, ["t1", "t2"], "left").join(shared_passages(rows), ["t1", "t2"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("n_shared", zero).alias("n_shared"))
