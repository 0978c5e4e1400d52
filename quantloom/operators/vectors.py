"""Nearest vectors through a cluster index, exact.

An index holds every vector in the list of its nearest pivot, with the distance to it. Pivots come from k-means on a sample of a stated size; any pivots give the same
answers, good ones skip more. Vectors are compared as unit vectors, where likeness falls as distance grows, so the triangle inequality holds:
  of a query, the k smallest sums (distance to a pivot + distance of a vector from that pivot) bound its k-th neighbour from above;
  a list whose nearest possible vector, by its radius or by the plane between two pivots, is beyond that bound is skipped;
  in a list, so are vectors whose distance from the pivot differs too much from the query's.
Lists and the queries that visit them are cut into blocks of bounded size, which meet by a shuffle; each hands on k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows that pivots are learned from, those with the least hash of their key, and the most pivots.
SAMPLE, LISTS = 20_000, 128
#: Vectors of a list, and queries of a list, that meet in one task.
BLOCK = 8_000
#: What distances may be off by: likeness counts to 12 places, which are up to 1.5e-6 of distance between vectors that are alike.
SLACK = 1e-5


def unit(vectors: np.ndarray, query: bool = False) -> np.ndarray:
    """Unit vectors with two more dimensions, in which zero vectors and zero queries stand apart from all: their likeness is 0."""
    size = np.linalg.norm(vectors, axis=1)
    out = np.zeros((len(vectors), vectors.shape[1] + 2))
    out[:, :-2] = vectors / np.where(size > 0, size, 1)[:, None]
    out[size == 0, -1 if query else -2] = 1
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a and each of b, of any length."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def pivots_of(sample: np.ndarray, most: int = LISTS, rounds: int = 8) -> np.ndarray:
    """k-means of a sample of unit vectors, from evenly spaced ones; at most `most` pivots, about the root of the sample."""
    k = max(1, min(most, int(np.sqrt(len(sample)))))
    pivots = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        owner = distances(sample, pivots).argmin(axis=1)
        for j in np.unique(owner):
            pivots[j] = sample[owner == j].mean(axis=0)
    return pivots


@dataclass
class VectorIndex:
    """rows: (key, embedding, list, away: the distance to the list's pivot). Per list: n, the radius, and the smallest distances (at most `kept`)."""

    rows: DataFrame
    pivots: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    nearest: list[np.ndarray]
    kept: int
    key: str


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1)


def build_index(vectors: DataFrame, key: str = "vec_id", x: str = "embedding", sample: int = SAMPLE, lists: int = LISTS, kept: int = 10) -> VectorIndex | None:
    """The index of all vectors(key, x) that are not null (all of one length, without nulls); None without any. kept: the most neighbours that may be asked for."""
    source = vectors.where(F.col(x).isNotNull()).select(key, F.col(x).cast("array<double>").alias("embedding"))
    got = source.withColumn("__h", F.xxhash64(key)).orderBy("__h", key).limit(sample).toPandas()
    if not len(got):
        return None
    pivots = pivots_of(unit(np.stack(got["embedding"].to_numpy())), lists)
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most `lists` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                away = distances(unit(_matrix(b.column(1))), sent.value)
                at = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(away[np.arange(len(at)), at])], names=[key, "embedding", "list", "away"])

    kind = source.schema[key].dataType.simpleString()
    rows = written(source.mapInArrow(run, f"`{key}` {kind}, embedding array<double>, list int, away double"))
    first = F.row_number().over(Window.partitionBy("list", "part").orderBy("away"))
    # the smallest distances of a list come from those of its parts, so that no list is sorted in one task
    least = rows.select("list", "away", F.pmod(F.xxhash64(key), F.lit(64)).alias("part")).withColumn("nth", first).where(F.col("nth") <= kept).groupBy("list").agg(F.slice(F.sort_array(F.collect_list("away")), 1, kept).alias("least"))
    stats = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).join(least, "list").collect()  # a row a list
    n, radius, nearest = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), [np.zeros(0)] * len(pivots)
    for r in stats:
        n[r["list"]], radius[r["list"]], nearest[r["list"]] = r["n"], r["radius"], np.array(r["least"])
    return VectorIndex(rows, pivots, n, radius, nearest, kept, key)


def visits(index: VectorIndex, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bound, visited): of unit queries an upper bound of the distance of the k-th neighbour, and which lists may hold nearer ones."""
    away = distances(queries, index.pivots)
    sums = np.concatenate([away[:, [j]] + d for j, d in enumerate(index.nearest) if len(d)], axis=1)
    bound = np.partition(sums, k - 1, axis=1)[:, k - 1] + SLACK if sums.shape[1] >= k else np.full(len(queries), np.inf)
    own = away.argmin(axis=1)
    apart = distances(index.pivots, index.pivots)[own]
    plane = (away**2 - away[np.arange(len(own)), own][:, None] ** 2) / np.where(apart > 0, 2 * apart, np.inf)
    beyond = np.maximum(away - index.radius, plane)
    return bound, (index.n > 0) & (beyond <= bound[:, None])


def nearest_in(index: VectorIndex, queries: DataFrame, k: int = 5, x: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query, key, likeness (cosine, rounded to 12 places), nth: the k vectors of the index most like each of queries(key, x), ties by key.

    Queries have keys of their own; null ones get no rows, a zero vector is like none (0).
    """
    if k > index.kept:
        raise ValueError(f"the index knows {index.kept} neighbours a list at most")
    key, spark = index.key, index.rows.sparkSession
    kind = index.rows.schema[key].dataType.simpleString()
    sent = spark.sparkContext.broadcast((index.pivots, index.n, index.radius, index.nearest))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = VectorIndex(None, *sent.value, index_kept, key)
        for b in batches:
            if b.num_rows:
                q = unit(_matrix(b.column(1)), True)
                bound, seen = visits(known, q, k)
                row, at = np.nonzero(seen)
                away = distances(q, known.pivots)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(away[row, at]), pa.array(bound[row])], names=["query", "q", "list", "apart", "bound"])

    index_kept = index.kept
    asked = queries.where(F.col(x).isNotNull()).select(key, F.col(x).cast("array<double>").alias("q"))
    going = written(asked.mapInArrow(plan, f"query {kind}, q array<double>, list int, apart double, bound double"))
    sizes = {r["list"]: r["n"] for r in going.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    cut = [(j, max(1, -(-int(index.n[j]) // block)), max(1, -(-sizes[j] // block))) for j in sizes]
    cuts = F.broadcast(spark.createDataFrame(cut, "list int, parts int, blocks int"))  # a row a list
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = index.rows.join(cuts, "list").select("list", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), every("blocks").alias("block"), key, "embedding", "away")
    sides = going.join(cuts, "list").select("list", every("parts").alias("part"), F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"), "query", "q", "apart", "bound")

    def meet(found: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(ask):
            return pd.DataFrame({"query": ask["query"][:0], key: found[key][:0], "likeness": np.zeros(0)})
        found = found.sort_values("away")
        lo, hi = np.searchsorted(found["away"], [(ask["apart"] - ask["bound"]).min() - SLACK, (ask["apart"] + ask["bound"]).max() + SLACK])
        found = found[lo:hi]
        s = np.round(unit(np.stack(ask["q"].to_numpy()), True) @ unit(np.stack(found["embedding"].to_numpy())).T, 12) if len(found) else np.zeros((len(ask), 0))
        names = np.broadcast_to(found[key].to_numpy(), s.shape)
        order = np.lexsort((names, -s), axis=1)[:, :k]
        return pd.DataFrame({"query": np.repeat(ask["query"].to_numpy(), order.shape[1]), key: np.take_along_axis(names, order, axis=1).ravel(), "likeness": np.take_along_axis(s, order, axis=1).ravel()})

    by = ["list", "part", "block"]
    best = vectors.groupBy(*by).cogroup(sides.groupBy(*by)).applyInPandas(meet, f"query {kind}, `{key}` {kind}, likeness double")
    return best.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("likeness"), key))).where(F.col("nth") <= k)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", x: str = "embedding") -> DataFrame:
    """`nearest_in` an index of the vectors."""
    index = build_index(vectors, key, x, kept=max(10, k))
    if index is None:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query {kind}, `{key}` {kind}, likeness double, nth int")
    return nearest_in(index, queries, k, x)
