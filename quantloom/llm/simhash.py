"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments. Of two or fewer differing bits, by the pigeonhole principle one segment has
none while the segment after it (in a ring) has at most one, so each fingerprint gets keys (exact segment, Golay codeword near the
next segment). Segments at distance one or less share a codeword within distance 4 of both, of which there are at most 6. Equal
keys are joined and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lower_words, schema, text_bytes, with_columns
from .components import connected_components

#: Segments of a fingerprint: (lowest bit, width). Each fits a Golay word of 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

#: Generator polynomial of the binary Golay code of length 23 (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


@cache
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome: the error patterns (at most 6) that lead to codewords within distance 4, and how many.

    The code is perfect with radius 3. A word at distance 3 from its codeword may have a neighbour that decodes elsewhere, so it
    also takes the five codewords at distance 4; a nearer word needs its own alone.
    """
    bits = 1 << np.arange(23)
    one = np.array([syndrome(int(b)) for b in bits])
    pats, syns = [np.array([0])], [np.array([0])]
    for _ in range(4):
        # patterns of the next weight: add a bit above the highest one
        p, s = [], []
        for i in range(23):
            low = pats[-1] < (1 << i)
            p.append(pats[-1][low] | bits[i])
            s.append(syns[-1][low] ^ one[i])
        pats.append(np.concatenate(p))
        syns.append(np.concatenate(s))
    table = np.zeros((2048, 6), np.int64)
    n = np.zeros(2048, np.int64)
    for w in range(4):
        table[syns[w], 0] = pats[w]
        n[syns[w]] = 1
    far = np.zeros(2048, bool)
    far[syns[3]] = True
    for e, s in zip(pats[4], syns[4], strict=True):
        if far[s]:
            table[s, n[s]] = e
            n[s] += 1
    return table, n


def syndrome(word: int) -> int:
    """The remainder of a 23-bit word by the generator."""
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word; they add up."""
    return np.array([syndrome(i) for i in range(4096)]), np.array([syndrome(i << 12) for i in range(2048)])


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints (uint64); a key packs the ring place, the exact segment and the codeword's index."""
    table, n = golay_keys()
    low, high = _syndromes()
    rows, keys = [], []
    cut = [(fps >> np.uint64(at) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
    for i in range(3):
        exact, near = cut[i], cut[(i + 1) % 3]
        syn = low[near & 4095] ^ high[near >> 12]
        for j in range(6):
            has = np.flatnonzero(n[syn] > j)
            # the high 12 bits of a codeword determine it
            code = (near[has] ^ table[syn[has], j]) >> 11
            rows.append(has)
            keys.append((np.int64(i) << 36) | (exact[has] << 12) | code)
    return np.concatenate(rows), np.concatenate(keys)


def simhash64(words: list[bytes], width: int = 3) -> int:
    """Bit i is set if it is in over half of the XXH64 (seed 42) of the word shingles, repeats included; 0 without words."""
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, 42) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) and fp: the 64-bit fingerprint as a long. Null text: as empty, fingerprint 0."""

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        fps = [simhash64(lower_words(t)) for t in text_bytes(batch)]
        return {"fp": pa.array(np.array(fps, np.uint64).view(np.int64))}

    return with_columns(docs, made, schema(fp="long"), keep)


def linked(distinct: DataFrame, most: int = 64, bits: int = 2) -> DataFrame:
    """Links (a, b) that connect exactly what distinct(fp) connects at `bits` (at most 2) or fewer differing bits.

    Fingerprints in buckets of at most `most` are compared pair by pair. Those in larger buckets take an exact way that needs no
    pairs: two words are within two bits just if they share a word within one bit of both, so each names its 65 neighbours, and all
    that name one are linked to the least of them.
    """
    assert bits == 2, "the keys and the ball cover two bits"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            rows, keys = fuzzy_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(keys)], names=["fp", "key"])

    keys = distinct.select("fp").mapInArrow(keyed, "fp long, key long")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpoint(keys.join(sizes, "key"))
    small = shared.where(F.col("n") <= most)
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, 65).view(np.int64)), pa.array((part[:, None] ^ flips).ravel().view(np.int64))], names=["fp", "near"])

    crowded = shared.where(F.col("n") > most).select("fp").distinct().mapInArrow(ball, "fp long, near long")
    least = crowded.groupBy("near").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = crowded.join(least, "near").where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Equal fingerprints, that of empty and null texts too, are one node, so groups of copies cost one row. Null ids count as above
    every other; a component of null ids alone has a null component_id. Repeated rows stay. Texts of any length are hashed whole. An empty
    table gives an empty result.
    """
    fps = checkpoint(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(checkpoint(linked(nodes)))  # node, root
    roots = labels.join(nodes, labels.node == nodes.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    moved = labels.join(roots, "root").select(F.col("node").alias("fp"), "component_id")
    # written, so that the join below is between two exchanges, of which adaptive execution can split a fingerprint with very many copies
    named = checkpoint(nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select("doc_id", hex16.alias("fingerprint"), "component_id")
