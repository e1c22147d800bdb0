"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are tokenised once; a document's ids are cut at multiples of the sequence length, so that only what is left
over has to be packed. Pieces go to groups by a hash of document and content (a group holds a bounded number of
documents whatever the input), and each group is packed on its own: pieces in falling length, each into the first bin
with room, found in O(log bins) by descending a complete binary tree whose nodes hold the largest free capacity below.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; null ids are kept; a text of
any length is cut into as many pieces as it takes; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, as the tokenizer's own pattern takes it (Python's \s has more).
SPACES = r" \t\n\x0b\x0c\r\x85\xa0  -     　"
CHUNKS = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Most chunks that a worker remembers the ids of.
REMEMBERED = 400_000
#: Longer chunks are not remembered.
REMEMBERED_CHARS = 64


class ChunkIds(dict):
    """The ids of a chunk, white space and what follows it, as little-endian unsigned 32-bit bytes. Byte-level BPE never
    merges across the border between a character and the white space after it, so a text's ids are those of its chunks.
    Where the same vocabulary is at hand as ranks, new chunks go to the faster library; the ids are the same.

    The tokenizer's special tokens, which have no white space, become their own ids where a text spells them, as the tokenizer has it;
    plain_special: they are spelt out like other text, so that no text can end a document for a trainer."""

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None, plain_special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            with open(tokenizer, encoding="utf-8") as f:
                special = {} if plain_special else {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}
            found = tiktoken.Encoding(os.path.basename(ranks), pat_str=pattern, mergeable_ranks=table, special_tokens=special)
            spelt = re.compile("|".join(map(re.escape, special)) or r"(?!)")
            self.of = lambda chunk: found.encode(chunk, allowed_special="all") if spelt.search(chunk) else found.encode_ordinary(chunk)
        else:
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(tokenizer)
            plain.encode_special_tokens = plain_special
            self.of = lambda chunk: plain.encode(chunk, add_special_tokens=False).ids

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.of(chunk)).tobytes()
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNKS.findall(text)))


_loaded: dict[tuple, ChunkIds] = {}


def chunk_ids(*tokenizer: str | bool | None) -> ChunkIds:
    """One cache for each tokenizer in a Python worker."""
    if tokenizer not in _loaded:
        _loaded[tokenizer] = ChunkIds(*tokenizer)
    return _loaded[tokenizer]


def pieces(docs: DataFrame, tokenizer: tuple[str | None, ...], id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, plain_special: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of the pieces of every document, and doc_crc32, a hash of all its ids.
    tokenizer: the arguments of ChunkIds, paths that every executor can open."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("start", "length", "ids_crc32", "doc_tokens", "doc_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(*tokenizer, *[None] * (3 - len(tokenizer)), plain_special)
        for b in batches:
            where, rows = [], []
            for k, text in enumerate(b.column(1)):
                data = ids.encode(text.as_py() or "") + end
                n, whole = len(data) // 4, zlib.crc32(data)
                for at in range(0, n, size):
                    part = data[4 * at : 4 * (at + size)]
                    where.append(k)
                    rows.append((at, len(part) // 4, zlib.crc32(part), n, whole))
            columns = np.array(rows, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where, pa.int64())), *(pa.array(c) for c in columns)], names=["doc_id", *names])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def first_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given; bins hold size. tree[1] is the root, tree[width + k] is bin k's room."""
    width = 1
    while width < len(lengths):
        width *= 2
    tree = [size] * (2 * width)
    used = [0] * width
    bins, offsets = [], []
    for need in lengths:
        node = 1
        while node < width:
            node *= 2
            if tree[node] < need:
                node += 1
        k = node - width
        bins.append(k)
        offsets.append(used[k])
        used[k] += need
        room = size - used[k]
        while node:
            tree[node] = room
            node //= 2
            if node:
                room = max(tree[2 * node], tree[2 * node + 1])
                if tree[node] == room:
                    break
    return bins, offsets


def pack(found: DataFrame, groups: int, size: int = 2048, seed: int = 7) -> DataFrame:
    """Give each piece a sequence_id and its offset there. Pieces of a document stay in the document's group."""
    kind = found.schema["doc_id"].dataType.simpleString()
    keyed = found.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_crc32"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit(table.column("length").to_pylist(), size)
        group = table.column("pack_group").to_numpy()
        sequence = (group << 32) + np.array(bins, np.int64)
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(np.array(offsets, np.int64)))

    return keyed.groupBy("pack_group").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: tuple[str | None, ...], id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, group_docs: int = 4096, min_groups: int = 1, plain_special: bool = False) -> DataFrame:
    """Pack all documents in groups of about group_docs documents each. The number of groups follows the number of rows. plain_special: see
    ChunkIds."""
    groups = max(min_groups, -(-docs.count() // group_docs))
    return pack(pieces(docs, tokenizer, id_col, text_col, size, end_id, plain_special), groups, size)
