"""Near copies by likeness: texts whose sets of five-word shingles have a Jaccard index of 0.8 or more.

SimHash fingerprints of the sets come first: those that Golay-code keys link within two bits are compared, and alike ones are one component.
That finds most copies at little cost, but many pairs at 0.8 are further apart than any keys of 64 bits reach, so the rest comes by a prefix
filter, which loses none: of two such sets, in any one order of all
shingles, the first n - ceil(0.8 n) + 1 of both share one. The order is
by hash, very common shingles last; which count as common bears on the speed alone. Those that share a shingle of their prefixes are
compared with the least of them first, and with others of them in turn where many would be left, then only across the components that this leaves, so
a large group of copies needs no pairs.
Pairs whose sets' parities differ too much are left out before sets meet. Shingles are 63-bit hashes, of which 32 bits are compared, so that two texts may link whose sets
are a few shingles further apart than they should be (one pair of shingles in 4 billion has equal bits); no pair is lost by it. Texts with equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, named, schema, slices, tokens_of, written
from .components import connected_components
from .simhash import linked

WIDTH = 5
#: Least likeness, as a fraction.
OF, LEAST = 5, 4
#: Shingles in so many texts of a slice are handed on to be counted, and the most common ones, at most so many, come last in the order.
OFTEN, COMMON_LEAST, COMMON = 3, 24, 1 << 20

#: Bits that mark nodes by hash, a megabyte whatever the corpus. Rounds in which all of a shingle meet one of them, while the others' pairs are over PAIRS a row
#: and a round leaves less than FEWER of them.
MARKS, ROUNDS, PAIRS, FEWER = 1 << 23, 6, 2, 0.9

#: Texts of a shingle up to which all of them meet, whatever their sizes.
FEW = 64
#: Pairs whose sizes n and m, and what follows a shingle at places p and q of their orders, let them be alike; at the first that alike ones share they pass.
FITS = f"{OF} * least(n, m) >= {LEAST} * greatest(n, m) AND {OF + LEAST} * least(n - p, m - q) >= {LEAST} * (n + m)"

_K = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(1 << 63)


def shingle_sets(column: pa.Array, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, shingles): text i has the distinct shingles[bounds[i] : bounds[i + 1]] in their order; those of `common` have the highest bit.

    A text of fewer than WIDTH words is one shingle, one without words has none.
    """
    t = tokens_of(column)
    n = len(column)
    words = np.fromiter(map(xxhash.xxh64_intdigest, t.distinct), np.uint64, len(t.distinct))
    at = np.arange(len(t.number))
    ends = np.flatnonzero(t.number < 0)
    left = ends[t.doc] - at  # words from here on
    own = np.where(t.number < 0, np.uint64(0), words[t.number] if len(words) else np.uint64(0)).astype(np.uint64)
    first = np.r_[True, t.number[:-1] < 0] if len(at) else np.zeros(0, bool)
    start = np.flatnonzero((left >= WIDTH) | (first & (left > 0)))
    h = np.zeros(len(start), np.uint64)
    for k in range(WIDTH):
        h = (h ^ np.where(left[start] > k, own[np.minimum(start + k, len(own) - 1)], np.uint64(0))) * _K
        h ^= h >> np.uint64(29)
    h = (h * _K) >> np.uint64(1)
    if len(common):
        place = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = np.where(common[place] == h, h | _LAST, h)
    doc = t.doc[start]
    stops = np.cumsum(np.bincount(doc, minlength=n)).tolist()
    for lo, hi in zip([0, *stops[:-1]], stops, strict=True):
        h[lo:hi].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]), h


def nodes_of(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A number of each text's set."""
    x = (shingles & ~_LAST) * _K
    x = (x ^ (x >> np.uint64(31))) * _K
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(29)), dtype=np.uint64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def fingerprints_of(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """SimHash of each text's set: a bit is 1 if set in over half of the hashes."""
    n = np.diff(bounds)
    out = np.zeros((len(n), 8), np.uint8)
    some = np.flatnonzero(n)
    x = (shingles & ~_LAST) * _K
    x = np.ascontiguousarray(x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8)
    if len(some):
        for byte in range(8):  # a byte of all hashes at a time
            ones = np.add.reduceat(np.unpackbits(x[:, byte : byte + 1], axis=1, bitorder="little"), bounds[:-1][some], axis=0, dtype=np.int32)
            out[some, byte] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little")[:, 0]
    return out.reshape(-1).view(np.int64)


def parities(bounds: np.ndarray, shingles: np.ndarray) -> pa.Array:
    """For each text's set, the parity of how many shingles fall in each of 64 or more slots (a power of two, the set's size or more, at most
    2 ** 16), as bytes. Two sets differ in at least as many shingles as their parities in bits; longer parities fold to shorter ones."""
    size = np.minimum(np.maximum(np.diff(bounds), 64), 1 << 16)
    bits = 1 << np.ceil(np.log2(size)).astype(np.int64)
    ends = np.cumsum(bits)
    own = np.repeat(np.arange(len(bits)), np.diff(bounds))
    slot = (shingles & (bits[own] - 1).astype(np.uint64)).astype(np.int64) + (ends - bits)[own]
    odd = np.bincount(slot, minlength=int(ends[-1]) if len(ends) else 0) & 1
    return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(np.r_[0, ends // 8].astype(np.int32)), pa.py_buffer(np.packbits(odd.astype(np.uint8), bitorder="little"))])


def may_be_alike(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs(a, b) without those whose parities, in known(node, size, bits), show that they differ in too many shingles: none alike is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y, s in zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                p, q = sorted((np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), key=len)
                while len(q) > len(p):
                    q = q[: len(q) // 2] ^ q[len(q) // 2 :]
                keep.append((OF + LEAST) * int(np.bitwise_count(p ^ q).sum()) <= (OF - LEAST) * s)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    x = known.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("size").alias("n"))
    y = known.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("size").alias("m"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", (F.col("n") + F.col("m")).alias("s")).mapInArrow(run, "a long, b long"))


def common_shingles(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, c = np.unique(shingle_sets(part.column(0), np.zeros(0, np.uint64))[1], return_counts=True)
                often = c >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(c[often])], names=["h", "c"])

    sums = docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON_LEAST)
    return np.sort(np.array([r.h for r in sums.orderBy(F.desc("c"), "h").limit(COMMON).select("h").collect()], np.int64).view(np.uint64))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets(node, shingles; 32 bits of each) have the least likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                both = len(np.intersect1d(p, q))
                keep.append(OF * both >= LEAST * (len(p) + len(q) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def place_of(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(MARKS)) + 1


def broadcast_marks(pairs: DataFrame) -> Broadcast:
    """MARKS bits, set at the places of all nodes in pairs(a, b)."""
    place = pairs.select(F.explode(F.array("a", "b")).alias("node")).select(place_of("node").alias("p"))
    bits, each = np.zeros(MARKS // 8, np.uint8), 4096
    for r in place.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect():  # MARKS bits at most
        bits[(r.k - 1) * each : r.k * each] = np.frombuffer(r.bits, np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(bits)


def picked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose __row is in chosen(__row), some of theirs, by two sets of marks: of the chosen ones and of the others.

    What only one of the sets has is settled where it lies. Just rows at places of both (few while all rows are fewer than the marks) are moved to be joined by their numbers.
    """

    def marks(numbers: DataFrame, name: str) -> DataFrame:
        """MARKS bits at most, 64 a row."""
        place = numbers.select(place_of("__row").alias("p"))
        words = place.groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias(name))
        return F.broadcast(words)

    others = rows.select("__row").join(chosen.select("__row"), "__row", "left_anti")
    marked = rows.withColumns({"__place": place_of("__row"), "__word": F.shiftright(place_of("__row"), 6)})
    marked = marked.join(marks(chosen, "__in"), "__word", "left").join(marks(others, "__out"), "__word", "left")
    has = "shiftright(coalesce({}, 0L), cast(__place & 63 AS int)) & 1L = 1L"
    sure = marked.where(f"{has.format('__in')} AND NOT ({has.format('__out')})").select(*rows.columns)
    doubtful = marked.where(f"{has.format('__in')} AND {has.format('__out')}").select(*rows.columns)
    return sure.unionAll(doubtful.join(chosen.select("__row"), "__row", "left_semi").select(*rows.columns))


def one_of_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies: the one of the least doc_id, null ids last.

    Rows count one by one, whatever ids they share. Texts without words are copies of each other.
    """
    columns, rest = docs.columns, [c for c in docs.columns if c not in ("doc_id", "text")]
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))  # COMMON numbers at most
    # other columns are put aside, so that their names clash with none below
    aside = [F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("__rest")] if rest else []
    plain = docs.select(*aside, "doc_id", "text")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch):
                bounds, shingles = shingle_sets(part.column(part.num_columns - 1), sent.value)
                size = np.diff(bounds)
                head = np.where(size > 0, size - (LEAST * size + OF - 1) // OF + 1, 0)
                at = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(head)[:-1]]), head) + np.arange(int(head.sum()))
                heads = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(head)]).astype(np.int32), pa.array(shingles[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(row + np.arange(part.num_rows)), pa.array(nodes_of(bounds, shingles)), pa.array(fingerprints_of(bounds, shingles)), parities(bounds, shingles), pa.array(size), heads], names=[*part.schema.names, "__row", "__node", "__fp", "__bits", "__size", "__heads"])
                row += part.num_rows

    rows = written(plain.mapInArrow(numbered, T.StructType([*plain.schema, *schema(__row="long", __node="long", __fp="long", __bits="binary", __size="long", __heads="array<long>")])))
    # the first row of equal sets speaks for them, by its number, which is shorter than the set's
    nodes = written(rows.groupBy("__node").agg(F.min("__row").alias("node")))
    heads = picked(rows.select("__row", "__size", "__heads"), nodes.select(F.col("node").alias("__row"))).withColumnRenamed("__row", "node")
    # place and size in one number
    heads = heads.select("node", "__size", F.posexplode("__heads").alias("place", "key")).select("key", "node", F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("__size")).alias("at"))
    # common shingles: counts first, then a join that adaptive execution can split, so that a shingle of very many texts is not one task's. All others have
    # few texts, so one exchange counts them and keeps those that two texts share
    common = heads.where("key < 0")
    often = common.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    of_key = Window.partitionBy("key")
    rare = heads.where("key >= 0").withColumns({"n": F.count(F.lit(1)).over(of_key), "least": F.min("node").over(of_key)}).where("n > 1")
    shared = common.join(often, "key").select("key", "node", "at", "n", "least").unionAll(rare.select("key", "node", "at", "n", "least"))
    shared = written(shared.select("key", "node", "n", "least", F.shiftright("at", 32).alias("place"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("size")))

    def setted(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy() - 1
            for part in slices(batch.filter(pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))):
                bounds, shingles = shingle_sets(part.column(1), np.zeros(0, np.uint64))
                raw = (shingles >> np.uint64(31)).astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[4 * i : 4 * j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["node", "shingles"])

    def likely(x: DataFrame) -> DataFrame:
        return written(x.where(FITS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def compared(met_pairs: DataFrame) -> DataFrame:
        """The alike ones of a written table of pairs, which goes."""
        pairs = may_be_alike(met_pairs, prints)
        dropped(met_pairs)
        # texts of pairs are picked where they lie, by marked bits: some others come along, none is moved
        marks = broadcast_marks(pairs)
        texts = rows.select(F.col("__row").alias("node"), "text", place_of("__row").alias("mark"))
        sets = written(texts.mapInArrow(lambda batches: setted(batches, marks), "node long, shingles binary"))
        found = alike(pairs, sets)
        dropped(pairs, sets)
        return found

    # fingerprints within two bits: each node with the least of its fingerprint, and these with each other
    prints = written(rows.where("__size > 0").select(F.col("__row").alias("node"), F.col("__fp").alias("fp"), F.col("__bits").alias("bits"), F.col("__size").alias("size")).join(nodes.select("node"), "node", "left_semi"))
    least = prints.groupBy("fp").agg(F.min("node").alias("a"))
    near = linked(least).join(least.select(F.col("fp").alias("x"), F.col("a").alias("p")), F.col("a") == F.col("x")).select("p", "b")
    near = near.join(least.select(F.col("fp").alias("y"), F.col("a").alias("q")), F.col("b") == F.col("y")).select("p", "q")
    near = near.unionAll(prints.join(least, "fp").where("node > a").select("a", "node"))
    copies = compared(written(near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()))
    roots = components_of(copies)

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of different components."""
        x, y = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
        return written(pairs.join(x, "a", "left").join(y, "b", "left").where("coalesce(x, a) != coalesce(y, b)").select("a", "b"))

    # every text with the least ones of its shingles: first the one of its most common shingle alone, which brings groups of copies together, then those that
    # are in other components still
    right = shared.where("node > least").select("key", F.col("node").alias("b"), F.col("place").alias("q"), F.col("size").alias("m"), F.col("n").alias("often"))
    heads_of = shared.where("node = least").select("key", F.col("node").alias("a"), F.col("place").alias("p"), F.col("size").alias("n"))
    met = written(heads_of.join(right, "key").where(FITS).groupBy("a", "b").agg(F.max("often").alias("often")))
    copies, roots = joined(copies, compared(apart(met.groupBy("b").agg(F.max_by("a", F.struct("often", "a")).alias("a")), roots)), roots)
    copies, roots = joined(copies, compared(apart(met, roots)), roots)
    dropped(met)
    def across(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Those of shingles of several components, but for each shingle's least one, with their roots; and of each such shingle the component with the most
        texts and the number of pairs across."""
        members = shared.where("n > 2 AND node > least").join(roots, "node", "left").select("key", "node", "place", "size", "n", F.coalesce("root", "node").alias("root"))
        counted = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
        of = counted.groupBy("key").agg(F.max(F.struct("c", "root")).alias("x"), F.count(F.lit(1)).alias("k"), ((F.pow(F.sum("c"), 2) - F.sum(F.pow("c", F.lit(2)))) / 2).alias("pairs"))
        return members, of.where("k > 1").select("key", F.col("x.root").alias("most"), "pairs")

    # while the pairs across components are many, all who share a shingle meet one of them, another in each round, of those whose first shingles it is among: a group of near copies in which few are alike to its
    # least one comes together without its pairs
    before = float("inf")
    for turn in range(ROUNDS):
        members, largest = across(roots)
        members = written(members.join(largest.select("key", "pairs"), "key"))
        n, pairs = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("pairs").alias("pairs")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first()
        more = None
        if pairs > PAIRS * n and pairs < FEWER * before:
            one = members.groupBy("key").agg(F.min_by(F.struct("node", "place", "size", "root"), F.struct("place", F.xxhash64("node", F.lit(turn)))).alias("x"))
            one = one.select("key", F.col("x.root").alias("r"), F.col("x.node").alias("a"), F.col("x.place").alias("p"), F.col("x.size").alias("n"))
            right = members.select("key", F.col("root").alias("s"), F.col("node").alias("b"), F.col("place").alias("q"), F.col("size").alias("m"))
            more = compared(likely(one.join(right, "key").where("r != s")))
        dropped(members)
        if more is None:
            break
        copies, roots = joined(copies, more, roots)
        before = pairs
    # across components, all who share a shingle; pairs with the least have been compared. Of each shingle the component with the most texts
    # meets the others only, so that a large group of copies makes no pairs of its own. Those of a shingle of many texts meet in classes of size, each a quarter
    # larger than the one before: alike ones are in one class or in neighbouring ones
    members, largest = across(roots)
    size_class = F.when(F.col("n") > FEW, F.floor(F.log("size") / float(np.log(OF / LEAST))).cast("int"))
    members = written(members.join(largest, "key").select("key", "node", "place", "size", "root", (F.col("root") == F.col("most")).alias("large"), F.coalesce(size_class, F.lit(-1)).alias("class")))
    near_class = F.explode(F.when(F.col("class") < 0, F.array("class")).otherwise(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))).alias("class")
    left = members.select("key", near_class, F.col("root").alias("r"), F.col("node").alias("a"), F.col("place").alias("p"), F.col("size").alias("n"), F.col("large").alias("l"))
    right = members.where("NOT large").select("key", "class", F.col("root").alias("s"), F.col("node").alias("b"), F.col("place").alias("q"), F.col("size").alias("m"))
    second = compared(likely(left.join(right, ["key", "class"]).where("l OR (r != s AND a < b)")))
    copies, roots = joined(copies, second, roots)
    found = rows.select("__row", "__node", "doc_id").join(nodes, "__node").join(roots, "node", "left")
    best = found.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))).alias("x"))
    best = written(best.select(F.col("x.__row").alias("__row")))
    dropped(nodes, shared, prints, members, roots)
    kept = picked(rows.select("__row", *(["__rest"] if rest else []), "doc_id", "text"), best)  # texts stay where they lie
    return kept.select(*[F.col(f"__rest.c{rest.index(c)}").alias(c) if c in rest else F.col(c) for c in columns])


def joined(copies: DataFrame, more: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, and the components of them; roots are those without `more`."""
    if more.isEmpty():
        return copies, roots
    every = copies.unionAll(more)
    dropped(roots)
    return every, components_of(every)


def components_of(links: DataFrame) -> DataFrame:
    labels = connected_components(links)
    roots = written(labels)
    dropped(labels)
    return roots
