"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Test items are parted by the size of their shingle set. In the partition of sizes up to u, an item's sketch holds its
k = u - ceil(t u) + 1 smallest shingle hashes (bottom-k MinHash; at most all of them): a document that contains a share t of the
item misses fewer than k of its shingles, so it has at least one of any k. A document is thus a candidate where it meets
a sketch, whatever its length, and none is missed. Candidates are verified by the exact share of the item's shingles that
the whole document has.

Documents are read once. Only the shingles that an item also has go on: the items' shingles are sent to all tasks up to SENT of
them; more are told by a table of bits of fixed size, and what it lets through is joined by a shuffle.

All of it is DataFrame functions. Words are runs of letters and digits in lower case, a shingle is 5 of them, its hash has
64 bits. Defined results: an item of fewer than 5 words has no shingle and matches nothing; null texts have no words;
repeated documents and items are matched each; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import likely, materialize

SHINGLE = 5
THRESHOLD = 0.8
#: Most shingles of items (16 bytes each) that are broadcast.
SENT = 1 << 20


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes of a text's word shingles."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(
        F.get(
            F.transform(
                F.array(F.transform(words, lambda w: F.xxhash64(w))),
                lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.xxhash64(*(F.get(c, i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>")),
            ),
            F.lit(0),
        )
    )


def item_sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """item_id, item (its shingles), n_item, and sketch, the smallest hashes; k is that of the item's size partition, the
    powers of two."""
    rows = items.select(F.col(id_col).alias("item_id"), shingle_hashes(F.col(text_col)).alias("item")).where(F.size("item") > 0)
    upper = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.size("item").cast("double")))), F.lit(1e9))
    k = upper - F.ceil(F.lit(threshold) * upper - 1e-9) + 1
    return rows.select("item_id", "item", F.size("item").alias("n_item"), F.slice(F.array_sort("item"), F.lit(1), k.cast("int")).alias("sketch"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, sent: int = SENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every document and item with containment of at least threshold."""
    known = materialize(item_sketches(items, item_id, item_text, threshold), "leak-items")
    wanted = materialize(known.select(F.explode("item").alias("wanted")).distinct(), "leak-shingles")
    listed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), shingle_hashes(F.col(f"`{text_col}`")).alias("hashes"))
    hashes = listed.select("row", "doc_id", F.explode("hashes").alias("h"))
    if wanted.count() <= sent:
        shared = hashes.join(F.broadcast(wanted), F.col("h") == F.col("wanted"), "left_semi")
    else:
        shared = likely(hashes, F.col("h"), wanted)[0].join(wanted, F.col("h") == F.col("wanted"), "left_semi")
    hits = materialize(shared.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("h").alias("hits")), "leak-hits")
    sketch = known.select(F.monotonically_increasing_id().alias("item_row"), "item_id", "item", "n_item", "sketch")
    sketch = materialize(sketch, "leak-sketches")
    met = hits.select("row", F.explode("hits").alias("h")).join(sketch.select("item_row", F.explode("sketch").alias("h")), "h").select("row", "item_row").distinct()
    pairs = met.join(hits, "row").join(sketch.select("item_row", "item_id", "item", "n_item"), "item_row")
    shared = F.size(F.array_intersect("hits", "item")).cast("long")
    return pairs.select("doc_id", "item_id", shared.alias("n_shared"), F.col("n_item").cast("long").alias("n_item")).where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))
