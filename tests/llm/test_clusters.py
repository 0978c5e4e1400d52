"""Delta Lloyd against plain Lloyd on integers."""

import hashlib
import math
import random

import numpy as np

from quantloom.llm.clusters import MOST, cluster_embeddings, delta_lloyd, nearest

DATA = "/root/testdata/sf0.001"


def plain(rows, k=8, rounds=10, dim=64):
    """(id, cluster, distance, cluster inertia, inertia, sha256) of each usable row of (id, vector)."""
    kept = [(i, [min(max(math.floor(1024 * float(x)), -MOST), MOST) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids)) for _, q in kept]
        if n < rounds:
            for j in range(len(centroids)):
                own = [q for (_, q), (_, owner) in zip(kept, found, strict=True) if owner == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = [sum(d for d, owner in found if owner == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, total[j], sum(total), sha[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_clusters_equal_plain_lloyd(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert rows_of(cluster_embeddings(vectors)) == plain([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_clusters_of_edge_vectors(spark):
    rng = random.Random(5)
    near = [(i, [float(rng.randrange(-3, 4)) / 1024 for _ in range(64)]) for i in range(60)]  # many ties
    same = [(100 + i, [0.5] * 64) for i in range(20)] + [(7, [0.25] * 64), (7, [0.125] * 64)]
    odd = [(200, None), (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (None, [0.1] * 64), (206, [1e30] + [-1e30] * 63), (207, [-0.0001] * 64)]
    rows = near + same + odd
    df = spark.createDataFrame([(i, v, 1, "o", 2) for i, v in rows], "vec_id long, embedding array<double>, row long, `owner` string, `a.b` int")
    assert rows_of(cluster_embeddings(df)) == plain(rows)
    assert cluster_embeddings(df.limit(0)).collect() == []
    few = df.where("vec_id IN (3, 4, 100)")
    assert rows_of(cluster_embeddings(few)) == plain([x for x in rows if x[0] in (3, 4, 100)])


def test_rounds_join_without_an_exchange(spark):
    found, centroids = delta_lloyd(spark.read.parquet(f"{DATA}/embeddings.parquet"), rounds=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(centroids) == 8 and "Exchange" not in plan


def test_only_changed_centroids_are_compared():
    q = np.array([[0, 0], [10, 0]])
    # the second centroid stands still: its vector keeps the distance it had, right or wrong, and leaves for the first alone
    owner, distance = nearest(q, np.array([[9, 0], [10, 1], [10, 0]]), np.array([0, 1]), np.array([5, 1]), np.array([True, False, False]))
    assert owner.tolist() == [0, 0] and distance.tolist() == [81, 1]
