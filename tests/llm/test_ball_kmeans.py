"""Ball k-means against plain k-means."""

import hashlib

import duckdb
import numpy as np
import pytest

from streamloom.llm import ball_kmeans as bk
from streamloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_reassignment_equals_all_comparisons(seed):
    rng = np.random.default_rng(seed)
    # Few different values, so that many distances are equal, and equal centroids.
    q, c = rng.integers(-3, 4, (2000, 3)), rng.integers(-3, 4, (12, 3))
    own, own_d = rng.integers(0, 12, 2000), bk.distances(q, c)
    got, d, _ = bk.reassign(q, own, c)
    assert (d == own_d.min(1)).all() and (got == own_d.argmin(1)).all()


def test_clear_clusters_are_not_compared():
    rng = np.random.default_rng(1)
    c = rng.integers(-10_000, 10_000, (40, 64))
    own = rng.integers(0, 40, 5000)
    q = c[own] + rng.integers(-5, 6, (5000, 64))
    got, _, worked = bk.reassign(q, own, c)
    assert (got == own).all() and worked == 5000


def plain(rows, k, rounds, seed, dim, scale):
    """rows: (id, vector), as the contract says."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest(), x[1]))[:k]
    c = [v for _, v in first]
    of = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [of(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, of(v)[1], of(v)[0]) for i, v in kept]
    sums = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, j, d, sums[j], sum(sums.values()), digest[j]) for i, j, d in out), key=repr)


def test_whole_run_against_plain_k_means(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(5, rows[9][1]), (5, rows[9][1]), (None, [0.5] * 4), (-3, [1.0] * 4)]
    rows += [(2000, None), (2001, [1.0] * 3), (2002, [1.0, None, 2.0, 3.0]), (2003, [float("nan")] * 4), (2004, [float("inf"), 1.0, 1.0, 1.0]), (2005, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((tuple(r) for r in bk.cluster(df, k=7, rounds=5, dim=4).collect()), key=repr)
    assert got == plain(rows, 7, 5, 2, 4, 256)


def test_few_none_and_extreme(spark):
    kind = "vec_id long, embedding array<double>"
    assert bk.cluster(spark.createDataFrame([], kind), dim=2).count() == 0
    two = bk.cluster(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], kind), k=40, dim=2).collect()
    assert sorted(r.cluster for r in two) == [0, 1] and {r.distance for r in two} == {0}
    most = (2**59) ** 0.5 // 2
    far = bk.cluster(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e200, 0.0])], kind), k=1, dim=2, rounds=1).collect()
    assert len(far) == 3 and all(0 <= r.distance <= (2 * most) ** 2 * 2 for r in far)
    with pytest.raises(ValueError):
        bk.cluster(spark.createDataFrame([], kind), k=0)


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    df = queries.op11_ball_clusters(spark, DATA)
    want = db.execute(bk.oracle()).fetchall()
    assert len(want) > 40 and sorted(tuple(r) for r in df.collect()) == sorted(want)
