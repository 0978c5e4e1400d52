"""Delta Lloyd: k-means on integers, exact, where a round looks only at what has moved.

Vectors become integers, floor(scale * x), once, in a bucketed table. Assignments (row, owner, distance) are a second table of the same buckets, so a
round joins both without an exchange. A vector whose centroid stood still keeps its distance and is compared with the changed centroids alone; one whose
centroid moved is compared with all. Sums and counts of clusters persist: a round adds the signed transfers of the vectors that changed their owner,
which its tasks sum up and write beside the assignments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, dropped

#: Largest size of an integer component; squared distances of 64 of them fit a long.
MOST = 1 << 27

#: Sums of tasks come to the driver in so many rows at most.
GROUPS = 32

STATE = "row long, owner int, distance long, transfers array<long>"


def usable(x: Column, dim: int) -> Column:
    """True for vectors of dim components, none null or non-finite."""
    return F.coalesce((F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))


def integers(x: Column, scale: int) -> Column:
    """floor(scale * x) of each component; beyond +-2^27 the nearest of these two."""
    return F.transform(x, lambda v: F.least(F.greatest(F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-2.0 * MOST)), F.lit(2.0 * MOST))), F.lit(-MOST)), F.lit(MOST)).cast("int"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[tuple[int, ...]]:
    """The k vectors(id, q) with the least sha256 of seed:id, of equal ones those with the least components; a null id counts as empty."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [tuple(r.q) for r in vectors.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()]


def nearest(q: np.ndarray, centroids: np.ndarray, owner: np.ndarray, distance: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New (owner, distance) of integer vectors q. changed: of each centroid; an owner of -1 counts as changed. Ties: the smaller number."""
    d = np.full((len(q), len(centroids)), np.iinfo(np.int64).max)
    stays = (owner >= 0) & ~changed[owner]
    moved = np.flatnonzero(~stays)
    for j, c in enumerate(centroids):
        if changed[j]:
            d[:, j] = ((q - c) ** 2).sum(axis=1)
        else:
            d[moved, j] = ((q[moved] - c) ** 2).sum(axis=1)
    kept = np.flatnonzero(stays)
    d[kept, owner[kept]] = distance[kept]
    best = d.argmin(axis=1)
    return best, d[np.arange(len(q)), best]


def transfers(q: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> np.ndarray:
    """For each cluster the signed count and sums of the vectors that came and went, (k, 1 + dim)."""
    out = np.zeros((k, 1 + q.shape[1]), np.int64)
    moved = before != after
    for j in range(k):
        came, went = q[moved & (after == j)], q[moved & (before == j)]
        out[j, 0] = len(came) - len(went)
        out[j, 1:] = came.sum(axis=0) - went.sum(axis=0)
    return out


def _round(rows: DataFrame, centroids: Sequence[Sequence[int]], changed: Sequence[bool]) -> DataFrame:
    """The next state of rows(row, q, owner, distance), and a row of transfers from each task."""
    table, moved = np.array(centroids, np.int64), np.array(changed, bool)
    k, dim = table.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((k, 1 + dim), np.int64), None
        names = ["row", "owner", "distance", "transfers"]
        for b in batches:
            if not b.num_rows:
                continue
            q = np.asarray(b.column(1).flatten(), np.int64).reshape(-1, dim)
            before = np.asarray(b.column(2), np.int64)
            after, distance = nearest(q, table, before, np.asarray(b.column(3), np.int64), moved)
            total += transfers(q, before, after, k)
            some = b.column(0)[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(after, pa.int32()), pa.array(distance), pa.nulls(b.num_rows, pa.list_(pa.int64()))], names=names)
        if some is not None and total.any():
            # under a row of its own, so that it lies in the same bucket
            yield pa.RecordBatch.from_arrays([pa.array([some], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([total.ravel()], pa.list_(pa.int64()))], names=names)

    return rows.select("row", "q", "owner", "distance").mapInArrow(run, STATE)


def summed(tasks: DataFrame) -> DataFrame:
    """transfers of tasks(row, transfers), a row a task, added up to at most GROUPS rows."""

    def run(rows: pa.Table) -> pa.Table:
        total = np.stack(rows.column("transfers").to_numpy(zero_copy_only=False)).sum(axis=0)
        return pa.table({"transfers": pa.array([total], pa.list_(pa.int64()))})

    return tasks.select("transfers", F.pmod(F.xxhash64("row"), F.lit(GROUPS)).alias("part")).groupBy("part").applyInArrow(run, "transfers array<long>")


def delta_lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", key: str = "vec_id", x: str = "embedding") -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(key, cluster, distance) of each usable vector, and the final centroids.

    Each round assigns all vectors to the nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces each non-empty one by the floor of
    its vectors' mean; at the end vectors are assigned once more. Rounds in which nothing would move are left out. Vectors of another length, with null or
    non-finite components, and null vectors take no part; components beyond +-2^27 after scaling count as that; rows that are alike count each; a null key stays
    null. With fewer than k vectors there are as many centroids; without any, no rows.
    """
    kept = vectors.where(usable(F.col(f"`{x}`"), dim)).select(F.col(f"`{key}`").alias("id"), integers(F.col(f"`{x}`"), scale).alias("q"))
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return kept.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    spark, k = vectors.sparkSession, len(centroids)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), kept.rdd.getNumPartitions())
    base = bucketed(kept.withColumn("row", F.monotonically_increasing_id()).repartition(n, "row"), "row", n)
    state = bucketed(_round(base.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long")}), centroids, [True] * k), "row", n)
    sums = np.zeros((k, 1 + dim), object)  # of Python's integers
    for _ in range(rounds):
        for r in summed(state.where("transfers IS NOT NULL")).collect():  # GROUPS rows at most
            sums += np.array(r["transfers"], object).reshape(sums.shape)
        now = [tuple(int(s) // int(row[0]) for s in row[1:]) if row[0] else c for row, c in zip(sums, centroids, strict=True)]
        changed = [a != b for a, b in zip(now, centroids, strict=True)]
        centroids = now
        if not any(changed):
            break
        before = state
        state = bucketed(_round(base.join(before.where("transfers IS NULL").hint("shuffle_hash"), "row"), centroids, changed), "row", n)
        dropped(before)
    found = base.select("row", "id").join(state.where("transfers IS NULL").hint("shuffle_hash"), "row")
    return found.select(F.col("id").alias(key), F.col("owner").alias("cluster"), "distance"), centroids


def cluster_embeddings(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 by `delta_lloyd`. Inertias beyond a long are null."""
    found, centroids = delta_lloyd(vectors)
    totals = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster

    def long(v: int) -> Column:
        return F.lit(v if v < 1 << 63 else None).cast("long")

    def pick(values: list[Column], kind: str) -> Column:
        return F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select("vec_id", "cluster", "distance", pick([long(totals.get(j, 0)) for j in range(len(centroids))], "long").alias("cluster_inertia"), long(sum(totals.values())).alias("inertia"), pick([F.lit(s) for s in sha], "string").alias("centroid_sha256"))
