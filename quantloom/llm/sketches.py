"""Bottom-k sketches of word-shingle hashes: mergeable, estimating resemblance, containment and distinct shingles."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_words, slices

#: Hashes in a sketch.
K = 128
#: Words in a shingle.
WIDTH = 5

#: Odd 64-bit multipliers that mix the words of a shingle (any would do; equal sketches need equal ones).
MIX = np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; fewer words than `width` make one shingle, none make none."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    if len(h) < width:
        return np.array([digest(b" ".join(words))], np.uint64)
    n = len(h) - width + 1
    x = np.zeros(n, np.uint64)
    for i in range(width):
        x = (x ^ h[i : i + n]) * MIX
        x ^= x >> np.uint64(29)
    x *= END
    return x ^ (x >> np.uint64(32))


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct hashes, in order."""
    if len(hashes) > 4 * k:
        # repeats may crowd out others below this bound; then all are looked at
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what a and b sketch."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: of the k least hashes of the union, those in both. Exact for fewer than k. Two empty sets: 1."""
    both = merge(a, b, k)
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both)) if len(both) else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k, else from the k-th least hash."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has. An empty a: 1."""
    if not len(a):
        return 1.0
    return float(min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k)))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(x: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(x), "<u8")


def merge_sketches(df: DataFrame, group: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """The sketch of each group's union: the group's columns and `merged`, a long array of hashes (as signed), by DataFrame functions.

    Each row gives at most k hashes, of which only the k least of each group stay, so a hot group's rows are thinned before they meet.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).to_pandas()
            out = [(key, np.unique(np.concatenate([from_text(x) for x in part[fingerprint].fillna("")]))[:k]) for key, part in t.groupby(group, dropna=False)]
            rows = [(*key, int(h)) for key, hs in out for h in hs.astype(np.uint64).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], b.schema.field(i).type) for i in range(len(group))] + [pa.array([r[-1] for r in rows], pa.int64())], names=[*group, "h"])

    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    hashes = df.select(*group, fingerprint).mapInArrow(spread, f"{fields}, h long").distinct()
    # unsigned order: the sign bit flipped
    order = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    nth = hashes.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("n") <= k)
    return nth.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]).alias("merged"))


def order_key(doc: Column, text: Column) -> Column:
    """A string that sorts as the documents do: by falling id, null ids last, then by a hash of the text."""
    falling = F.lpad(F.hex(doc.bitwiseXOR(F.lit(2**63 - 1))), 16, "0")
    return F.concat(F.coalesce(falling, F.lit("null")), F.lpad(F.hex(F.xxhash64(F.coalesce(text, F.lit("")))), 16, "0"))


def place_of(key: Column, edges: list[str], step: int = 256) -> Column:
    """The number of the last of the edges (rising) that is not above the key: first among every step-th, then in the run that follows."""
    below = lambda some: F.size(F.filter(some, lambda e: e <= key))
    runs = [F.array(*[F.lit(e) for e in edges[i : i + step]]) for i in range(0, len(edges), step)]
    if len(runs) == 1:
        return below(runs[0]) - 1
    run = below(F.array(*[F.lit(e) for e in edges[::step]]))
    return (run - 1) * step + below(F.element_at(F.array(*runs), run)) - 1


def ordered_neighbours(docs: DataFrame, parts: int, least_hot: int = 1000) -> DataFrame:
    """docs(doc_id, text) in at most `parts` ranges of their order, each with the first row of the next appended.

    Columns key, doc_id, text, part, donor, times; donor rows belong to another range and only serve as a neighbour. Only keys are looked at
    for the ranges; each text moves once. Of rows alike in id and text that would fill half a range (and are more than least_hot), one
    moves: times says how many they are.
    """
    placed = docs.withColumn("key", order_key(F.col("doc_id"), F.col("text")))
    counted = placed.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    edges = sorted(r.e for r in counted.select("key").repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("e")).collect())  # a row a range
    if not edges:
        return placed.select("key", "doc_id", "text", F.lit(0).alias("part"), F.lit(False).alias("donor"), F.lit(1).cast("long").alias("times"))
    placed = placed.withColumn("part", place_of(F.col("key"), edges))
    rows = placed.count()
    hot = [(r.key, r.times) for r in counted.where(F.col("times") > max(least_hot, rows // (2 * len(edges)))).collect()]  # 2 * parts rows at most
    spark = docs.sparkSession
    single = F.lit(1).cast("long").alias("times")
    out = placed.select("key", "doc_id", "text", "part", F.lit(False).alias("donor"), single)
    if hot:
        known = F.broadcast(spark.createDataFrame(hot, "key string, times long"))
        one = placed.join(known, "key").groupBy("key", "times").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("part").alias("part"))
        out = out.join(known.select("key"), "key", "left_anti").unionAll(one.select("key", "doc_id", "text", "part", F.lit(False).alias("donor"), "times"))
    # the first range's first row serves the last range
    gives = F.broadcast(spark.createDataFrame([(e, (i or len(edges)) - 1) for i, e in enumerate(edges)], "key string, donate int"))
    donors = placed.join(gives, "key").groupBy("key", "donate").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return out.unionAll(donors.select("key", "doc_id", "text", F.col("donate").alias("part"), F.lit(True).alias("donor"), single))


def edited_text(text: str, following: str) -> str:
    """The last third of the text's code points gives way to the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_edits(docs: DataFrame, parts: int | None = None, least_hot: int = 1000) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, contained.

    The next document is that after it by falling doc_id (after the last: the first); null ids come last, rows of one id go by a hash of
    their text. A null text is empty. A sketch of no shingles is the empty string, and two such are alike (1.0). A table of one row is its
    own neighbour; an empty table gives an empty result. Texts of any length are read whole. contained: the estimated share of the text's
    shingles in the edited text.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts is None:
        parts = max(n, 2 * source.rdd.getNumPartitions())
    # each range is a partition, so that no two share a task
    dealt = ordered_neighbours(source, parts, least_hot)
    dealt = dealt.repartitionById(max(parts, n), F.col("part").cast("int")).sortWithinPartitions("part", "donor", "key").drop("key")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "contained", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose follower is still to come

        def row(this: tuple, after: tuple, times: int = 1) -> tuple:
            doc, text, own = this[0], this[1], this[4]
            edited = edited_text(text, after[1]).encode()
            other = sketch(shingle_hashes(edited))
            return (doc, len(text), hashlib.sha256(edited).hexdigest(), to_text(own), to_text(other), resemblance(own, other), resemblance(own, after[4]), int(round(distinct(own))), containment(own, other), times)

        for batch in batches:
            for piece in slices(batch):
                rows = []
                for doc, text, part, donor, times in zip(*[c.to_pylist() for c in piece.columns], strict=True):
                    if donor and (held is None or held[3] or held[2] != part):
                        continue
                    now = (doc, text or "", part, donor, sketch(shingle_hashes((text or "").encode())))
                    if held is not None and not held[3] and held[2] == part:
                        rows.append(row(held, now))
                    if times > 1:  # alike rows follow each other
                        rows.append(row(now, now, times - 1))
                    held = now
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles long, contained double, times long")
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*names[:-1])
