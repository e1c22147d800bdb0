"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import discard, materialize


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) for every node of edges (u long, v long); label is a node of the same component.

    Each round every node moves to the smallest of its neighbours and itself, and edges move along, until no edge is left;
    the image of a connected graph is connected, so labels that met stay together.
    Nodes are compared by a bijective hash, so that chains of falling ids shrink by a constant factor a round. Hot nodes
    only ever meet in partial aggregates and in joins of two plain exchanges, which adaptive execution splits.
    Null ends are dropped; an empty table gives an empty one.
    """
    live = materialize(edges.where("u != v").select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")).distinct(), name)
    ids = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.explode(F.array("u", "v")).alias("node")).distinct()
    labels = materialize(ids.select("node", F.xxhash64("node").alias("label")), name)
    names = labels
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("child"), F.least("u", "v").alias("parent")), name)
        # One step of pointer jumping halves what chains are left.
        up = parent.select(F.col("child").alias("c2"), F.col("parent").alias("p2"))
        jump = materialize(parent.join(up, F.col("parent") == F.col("c2"), "left").select("child", F.coalesce("p2", "parent").alias("parent")), name)
        start = jump.select(F.col("child").alias("u"), F.col("parent").alias("pu"))
        end = jump.select(F.col("child").alias("v"), F.col("parent").alias("pv"))
        moved = live.join(start, "u").join(end, "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u != v").distinct()
        after = materialize(moved, name)
        relabelled = materialize(labels.join(jump, F.col("label") == F.col("child"), "left").select("node", F.coalesce("parent", "label").alias("label")), name)
        for old in (live, parent, jump):
            discard(old)
        if labels is not names:
            discard(labels)
        live, labels = after, relabelled
    back = names.select(F.col("node").alias("head"), F.col("label").alias("label"))
    return labels.join(back, "label").select("node", F.col("head").alias("label"))
