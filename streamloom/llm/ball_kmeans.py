"""Centroid clustering with balls, in whole numbers.

A cluster is a ball: its centroid and the greatest distance of a member. Only centroids closer than twice that radius are its
neighbours. Members closer to their centroid than half the way to the nearest neighbour are the stable core and stay without a
comparison; the others lie in annuli, and those of the j-th one are compared exactly with the j nearest neighbours alone.
A point at squared distance s of its own centroid can't leave for a centroid at squared distance t of that one if 4 s < t; as all
numbers are whole, the test is exact, and ties (4 s = t) are compared.

Balls are drawn around the members that a task holds at a time, which are smaller than those around all members; vectors never
move between tasks. A round writes the vectors with their clusters and gathers sums, k rows for each task. What the driver
holds is k centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import discard, materialize

#: The centroids may have so many components together; they are sent to every task.
MOST_COMPONENTS = 1 << 20


def quantised(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id and q, whole numbers floor(scale * x), of the vectors that have dim components, none of them null or not finite.
    Components beyond a bound (2**26 for 64 of them) are cut to it, so that squared distances fit 64 bits."""
    v = F.col(f"`{vec_col}`")
    # Never null: a null vector or component gives false.
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    most = math.isqrt(2**60 // dim) // 2
    q = F.transform(v, lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    return df.where((F.size(v) == dim) & whole).select(F.col(f"`{id_col}`").alias("vec_id"), q.alias("q"))


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of q to every row of c."""
    return (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (q @ c.T)


def nearest(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid, the smaller number of equal ones, by comparing all."""
    d = distances(q, c)
    best = d.argmin(1)
    return best, d[np.arange(len(q)), best]


def reassign(q: np.ndarray, own: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As nearest(), from the clusters that vectors have now; the last is the number of distances that were worked out."""
    best, best_d = own.copy(), ((q - c[own]) ** 2).sum(1)
    own_d, worked = best_d.copy(), len(q)
    between = distances(c, c)
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        others = np.argsort(between[i], kind="stable")
        others = others[others != i]
        radius = own_d[members].max()
        others = others[between[i, others] <= 4 * radius]
        # The number of neighbours that a member may be as close to: 0 in the stable core, else its annulus.
        annulus = np.searchsorted(between[i, others], 4 * own_d[members], side="right")
        outer = np.argsort(-annulus, kind="stable")
        for j, other in enumerate(others):
            at = members[outer[: np.count_nonzero(annulus > j)]]
            d = ((q[at] - c[other]) ** 2).sum(1)
            worked += len(at)
            better = (d < best_d[at]) | ((d == best_d[at]) & (other < best[at]))
            best[at[better]], best_d[at[better]] = other, d[better]
    return best, best_d, worked


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assigned(state: DataFrame, c: np.ndarray, first: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("q"), c.shape[1])
            best, d = nearest(q, c) if first else reassign(q, b.column("cluster").to_numpy().astype(np.int64), c)[:2]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(best, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "q", "cluster", "distance"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return materialize(state.mapInArrow(run, f"vec_id {kind}, q array<int>, cluster int, distance long"), "balls")


def _means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids of the clusters: componentwise floors of exact means; those of empty clusters stay."""
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), np.int64)
        for b in batches:
            if b.num_rows:
                own = b.column("cluster").to_numpy()
                np.add.at(sums, (own, slice(dim)), _matrix(b.column("q"), dim))
                sums[:, dim] += np.bincount(own, minlength=k)
        met = np.flatnonzero(sums[:, dim])
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(met, dim + 1), pa.int32()), "at": pa.array(np.tile(np.arange(dim + 1), len(met)), pa.int32()), "x": pa.array(sums[met].ravel(), pa.int64())})

    found = state.select("cluster", "q").mapInArrow(run, "cluster int, at int, x long").groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros((k, dim + 1), np.int64)
    for r in found:
        sums[r.cluster, r.at] = r.x
    n = sums[:, dim]
    return np.where(n[:, None] > 0, sums[:, :dim] // np.maximum(n, 1)[:, None], c)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> DataFrame:
    """Cluster vectors by so many rounds of exact k-means over whole numbers, and assign them once more.

    Centroids start as the k vectors with the smallest sha256 of "seed:id" (of equal ids, those with smaller components). Returns
    vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256, one row for each vector that quantised() keeps.

    Defined results: vectors that are null, of another length, or with null, NaN or infinite components give no row; a null id is
    like any other, but such vectors start no cluster unless there are too few others. Equal vectors and repeated rows are rows each.
    Fewer than k vectors make fewer clusters; an empty table gives an empty one. Other columns are not read. A sum of distances
    beyond 64 bits is null."""
    if not 0 < k * dim <= MOST_COMPONENTS:
        raise ValueError(f"k * dim must be from 1 to {MOST_COMPONENTS}")
    kept = materialize(quantised(df, id_col, vec_col, dim, scale), "vectors")
    label = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(label.asc_nulls_last(), "q").limit(k).select("q").collect()
    c = np.array([r.q for r in starts], np.int64).reshape(-1, dim)
    state = _assigned(kept.withColumn("cluster", F.lit(0)), c, first=True) if len(c) else materialize(kept.select("*", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "balls")
    for _ in range(rounds if len(c) else 0):
        c = _means(state, c)
        after = _assigned(state, c, first=False)
        discard(state)
        state = after
    discard(kept)
    sums = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = None if None in sums.values() or sum(sums.values()) >= 2**63 else sum(sums.values())
    digest = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    table = state.sparkSession.createDataFrame([(i, s, total, digest[i]) for i, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> str:
    """The same over the table embeddings, all vectors against all centroids in every round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""a{t} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
            SELECT vec_id, v.q, c, CAST(list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.q[i] - c{t}.q[i]) * (v.q[i] - c{t}.q[i]))) AS BIGINT) AS d FROM v, c{t}) GROUP BY vec_id)"""
        )
        if t < rounds:
            parts.append(
                f"""c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(u.q, o.q) AS q FROM c{t} o LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
                  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{t}) GROUP BY c, i) GROUP BY c) u ON u.c = o.c)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(o.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} o ON o.c = a.c"""
