"""Histogram sort: documents to shards of near equal bytes, by exact counts below probed keys.

The order is (hash of the text, hash of the id and the row). Rounds count the exact bytes and rows between candidate boundaries over all
partitions, then probe anew inside the intervals that hold a wanted boundary, until every splitter is within tolerance. Only then
do rows move, once. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

KEY_BITS = 62


@dataclass
class Target:
    """A wanted boundary: the interval [lo, hi) that holds it, of keys or (level 2) of id hashes under one key."""

    bytes: float
    lo: int = 0
    hi: int = 1 << KEY_BITS
    below: int = 0
    key: int | None = None
    found: tuple[int, int] | None = None
    edges: tuple[tuple[tuple[int, int], int], ...] = ()


def _width(t: Target, probes: int) -> int:
    return max(1, -(-(t.hi - t.lo) // probes))


def find_splitters(keyed: DataFrame, total: int, shards: int, probes: int = 64, tolerance: float = 0.001, whole_groups: float = 0.02) -> list[tuple[int, int]]:
    """shards - 1 splitters (k1, k2) of keyed(k1, k2, size), at which the bytes below are near i * total / shards.

    tolerance: of a shard's bytes, at which probing ends. Rows of one key stay together if a boundary beside them is within
    whole_groups of a shard's bytes; else the key is split by k2. Each round sends at most (shards - 1) * probes counts to the driver.
    """
    share = total / shards
    targets = [Target(share * i) for i in range(1, shards)]
    while active := [t for t in targets if t.found is None]:
        spans = list(dict.fromkeys((t.key, t.lo, t.hi) for t in active))
        bucket = F.lit(None).cast("long")
        for i, (key, lo, hi) in enumerate(spans):
            w = _width(Target(0, lo, hi), probes)
            on = F.col("k1") if key is None else F.col("k2")
            inside = (on >= lo) & (on < hi)
            if key is not None:
                inside = inside & (F.col("k1") == key)
            bucket = F.when(inside, F.lit(i * probes) + F.floor(F.expr(f"({'k1' if key is None else 'k2'} - {lo}L) div {w}L"))).otherwise(bucket)
        rows = keyed.select(bucket.alias("b"), "size").where("b is not null").groupBy("b").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        counts = {r.b: (r.s, r.n) for r in rows}
        for t in active:
            i, w = spans.index((t.key, t.lo, t.hi)), _width(t, probes)
            cum = t.below
            for j in range(probes):
                s, n = counts.get(i * probes + j, (0, 0))
                if cum + s >= t.bytes or j == probes - 1:
                    break
                cum += s
            lo, hi = t.lo + j * w, min(t.lo + (j + 1) * w, t.hi)
            at = (lambda x, t=t: (x, 0) if t.key is None else (t.key, x))
            edges = [(at(lo), cum), (at(hi) if t.key is None or hi < t.hi or n > 1 else (t.key, hi), cum + s)]
            if t.key is not None:
                edges += t.edges
            best, off = min(((e, abs(c - t.bytes)) for e, c in edges), key=lambda x: x[1])
            if off <= tolerance * share or n <= 1 or (w == 1 and t.key is not None):
                t.found = best
            elif w == 1:
                if off <= whole_groups * share:
                    t.found = best
                else:
                    t.key, t.edges, t.lo, t.hi, t.below = lo, tuple(edges), 0, 1 << KEY_BITS, cum
            else:
                t.lo, t.hi, t.below = lo, hi, cum
    return sorted(t.found for t in targets)


def histogram_sort(docs: DataFrame, shards: int = 8, ranges: int = 256, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 200_000, most_ranges: int = 1 << 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1 (null text: 1). Sizes of the shards are near equal; equal texts stay in one shard where
    that leaves the shard within 2 percent, else they are dealt by hashes of id and row. Null ids are an ordinary key. Repeated rows each get
    a slot. Texts of any length are one row. An empty table gives an empty result. Only the named columns are read, so others of any name do
    no harm.

    Slots are numbered in (shard, range, part) pieces. There are `ranges` ranges or, for large tables, one for each rows_a_range rows, at
    most most_ranges; a text with more rows than two ranges has parts of its own, one for each range that it would fill.
    """
    text, doc = F.col(text_col), F.col(id_col)
    # numbers only, written once: what is dealt by row stays so if a task runs again
    keyed = written(
        docs.select(
            doc.cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - KEY_BITS).alias("k1"),
            F.shiftrightunsigned(F.xxhash64(doc, F.monotonically_increasing_id()), 64 - KEY_BITS).alias("k2"),
        )
    )
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    splitters = find_splitters(keyed, total, shards) if n else []

    bits = max(1, min(most_ranges, max(ranges, n // rows_a_range)) - 1).bit_length()
    each = max(1000, n >> bits)
    shard = F.lit(0)
    for s1, s2 in splitters:
        shard = shard + F.when((F.col("k1") > s1) | ((F.col("k1") == s1) & (F.col("k2") >= s2)), 1).otherwise(0)
    # texts that alone fill two ranges, at most half as many as ranges, and their parts; the others are part 0
    hot = keyed.groupBy("k1").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 2 * each).select("k1", F.ceil(F.col("c") / each).alias("parts"))
    hot = docs.sparkSession.createDataFrame(hot.collect(), "k1 long, parts long")
    placed = keyed.withColumn("shard", shard.cast("int")).withColumn("cell", F.shiftright("k1", KEY_BITS - bits)).join(F.broadcast(hot), "k1", "left")
    part = F.when(F.col("parts").isNotNull(), 1 + F.pmod(F.xxhash64("k1", "k2"), F.col("parts"))).otherwise(0)
    placed = placed.withColumn("part", part.cast("long")).drop("parts")

    counts = sorted(tuple(r) for r in placed.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("c")).collect())
    starts, at, last = [], 0, None
    for s, cell, p, c in counts:
        at = 0 if s != last else at
        starts.append((s, cell, p, at))
        at, last = at + c, s
    # at most 3 * 2 ** bits + shards rows
    starts = docs.sparkSession.createDataFrame(starts, "shard int, cell long, part long, start long")
    w = Window.partitionBy("shard", "cell", "part").orderBy("k1", "k2", "doc_id", "size", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(w))
        .join(F.broadcast(starts), ["shard", "cell", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
