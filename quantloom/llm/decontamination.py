"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

A seed is two words of a test item, neighbours or one apart. An alignment at the threshold can't do without them: of its M matching words and X
other columns, 2 M - X >= 2 t n (n the item's words, t the threshold), and two matches in turn that are further apart than a seed take two of
the X, so at least t n - 1 of the M - 1 turns are seeds, inside 3 n - 2 t n words of text. Windows with fewer hits needn't be aligned, so
nothing is lost. Where t n is 1 or less one matching word is a passage, and the seeds are the words themselves. Of each item the most frequent seeds go, up to
half of those that a passage must have, and the hits asked for go down by as many. Substitutions, insertions and drops count alike, and one rule holds for
items of all sizes: of an item of very few words a word or two are a passage, so leaks gives the item's words and the share, by which a user may cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tokens_of

#: Words from the first to the second of a seed, in items and in texts.
REACH = 2
#: A seed is frequent if the corpus has it more than so many times as often as its item's median seed.
RARE = 2
#: Scores of an alignment.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's perfect score at which a passage is a copy of it.
THRESHOLD = 0.4
#: Cells of the alignment tables that are worked on at once.
CELLS = 2_000_000
#: Bytes of test items that are broadcast as one block; more items go block by block, each with a scan of its own.
BLOCK_BYTES = 8_000_000
#: Seeds are counted by so many bits of their hash.
SLOT_BITS = 20

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its row) of a column of texts, an end (hash 0) after each; words are runs of letters, digits and all beyond
    ASCII, A-Z lower-cased."""
    t = tokens_of(column, _WORD)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, t.distinct), np.uint64, len(t.distinct)) | np.uint64(1)
    return np.where(t.number < 0, np.uint64(0), own[t.number] if len(own) else np.uint64(0)).astype(np.uint64), t.doc


def seed_keys(words: np.ndarray, doc: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of the pairs of words `apart` words apart in one text; with 0 the words themselves."""
    if apart == 0:
        at = np.flatnonzero(words != 0)
        return at, words[at] * _K1
    a, b = words[:-apart], words[apart:]
    known = (a != 0) & (b != 0)
    if apart > 1:
        known &= doc[:-apart] == doc[apart:]
    at = np.flatnonzero(known)
    key = a[at] * _K1
    key ^= key >> np.uint64(29)
    return at, (key + b[at]) * _K2


def slot(keys: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Items:
    """A block of test items: their words, and their seeds in the order of keys."""

    ids: list
    words: list[np.ndarray]
    keys: np.ndarray  # sorted, one row for each item, place and reach
    item: np.ndarray
    at: np.ndarray
    need: np.ndarray  # hits that a passage of each item has at least
    span: np.ndarray  # words that it has at most
    singles: bool  # if some seeds are words

    def __post_init__(self) -> None:
        self.bits = min(24, max(12, int(len(self.keys)).bit_length() + 4))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[slot(self.keys, self.bits)] = True


def index_items(rows: list[tuple], threshold: float = THRESHOLD) -> Items:
    """Of (id, text). Items without words are never found."""
    column = pa.array([t or b"" for _, t in rows], pa.binary()).cast(pa.string())
    words, doc = words_of(column)
    size = np.bincount(doc, minlength=len(rows)) - 1 if len(rows) else np.zeros(0, np.int64)
    first = np.cumsum(size + 1) - (size + 1)
    keys, item, at = [], [], []
    for apart in range(REACH + 1):
        i, k = seed_keys(words, doc, apart)
        keep = (threshold * size[doc[i]] <= 1 + 1e-9) == (apart == 0)
        i, k = i[keep], k[keep]
        keys.append(k)
        item.append(doc[i])
        at.append(i - first[doc[i]])
    keys, item, at = (np.concatenate(x) for x in (keys, item, at))
    order = np.argsort(keys, kind="stable")
    need = np.maximum(1, np.ceil(threshold * size - 1 - 1e-9)).astype(np.int64)
    span = np.ceil(size * (3 - 2 * threshold)).astype(np.int64)
    lists = [words[a : a + n].view(np.int64) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
    return Items([r[0] for r in rows], lists, keys[order], item[order].astype(np.int32), at[order].astype(np.int32), need, span, bool((threshold * size[size > 0] <= 1 + 1e-9).any()))


def rare_seeds(items: Items, counts: np.ndarray) -> Items:
    """items without their frequent seeds (by counts of their slots in the corpus), their needs lowered by as many places.

    At most half of the hits that a passage must have are given up, so that every passage still has some.
    """
    if not len(items.keys):
        return items
    n = counts[slot(items.keys)]
    # by item and place, the most frequent seed of each
    place = items.item.astype(np.int64) << 32 | items.at
    order = np.lexsort((-n, place))
    ahead = order[np.r_[True, place[order][1:] != place[order][:-1]]]
    order = ahead[np.lexsort((-n[ahead], items.item[ahead]))]  # each item's places from the most frequent on
    own = items.item[order]
    start = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
    length = np.diff(np.r_[start, len(own)])
    rank = np.arange(len(own)) - np.repeat(start, length)
    median = np.repeat(n[order][start + length // 2], length)
    spare = items.need[own] // 2
    gone = (rank < spare) & (n[order] > RARE * median)
    need = items.need - np.bincount(own[gone], minlength=len(items.ids))
    keep = ~np.isin(place, place[order[gone]])
    return Items(items.ids, items.words, items.keys[keep], items.item[keep], items.at[keep], need, items.span, items.singles)


def candidate_windows(items: Items, words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, from, to) of places in the texts to align: around every run of as many hits as an item's passage has, near enough."""
    at, entry = [], []
    for apart in range(0 if items.singles else 1, REACH + 1):
        i, k = seed_keys(words, doc, apart)
        some = items.maybe[slot(k, items.bits)]
        i, k = i[some], k[some]
        lo, hi = np.searchsorted(items.keys, k, "left"), np.searchsorted(items.keys, k, "right")
        n = hi - lo
        at.append(np.repeat(i, n))
        entry.append(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
    at, entry = np.concatenate(at), np.concatenate(entry)
    if not len(at):
        return []
    item, row = items.item[entry].astype(np.int64), doc[at]
    if len(items.ids) * (int(doc[-1]) + 1) <= CELLS:  # too few hits in the whole text
        pair = row * len(items.ids) + item
        some = np.bincount(pair)[pair] >= items.need[item]
        at, item, row = at[some], item[some], row[some]
        if not len(at):
            return []
    order = np.lexsort((at, item, row))
    at, item, row = at[order], item[order], row[order]
    need, span = items.need[item], items.span[item]
    last = np.arange(len(at)) + need - 1
    inside = np.minimum(last, len(at) - 1)
    good = np.flatnonzero((last < len(at)) & (row[inside] == row) & (item[inside] == item) & (at[inside] - at <= span))
    if not len(good):
        return []
    at, end, item, row, span = at[good], at[inside[good]], item[good], row[good], span[good]
    # neighbours whose windows touch are one
    lo, hi = end - span, at + span
    new = np.r_[True, (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(item)] - 1
    stop = np.cumsum(np.bincount(doc)) - 1  # of each text, its end
    begin = np.r_[0, stop[:-1] + 1]
    out = []
    for r, i, x, y, n in zip(row[first].tolist(), item[first].tolist(), np.maximum(lo[first], begin[row[first]]).tolist(), np.minimum(hi[last] + 1, stop[row[first]]).tolist(), span[first].tolist(), strict=True):
        # long ones in windows of sixteen passages, of which neighbours share two
        out += [(r, i, a, min(y, a + 16 * n)) for a in range(x, max(x + 1, y - 2 * n), 14 * n)]
    return out


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair: score, and where in the passage it starts and ends.

    All pairs run side by side, a word of the items at a time; gaps inside a row are the running maximum of the row's scores less a
    gap a step. Word 0 matches nothing.
    """
    k = len(items)
    n, m = max(map(len, items), default=0), max(map(len, passages), default=0)
    a, b = np.full((k, n), -1, np.int64), np.zeros((k, m), np.int64)
    for i in range(k):
        a[i, : len(items[i])] = items[i]
        b[i, : len(passages[i])] = passages[i]
    # score << 32 | 2^32 - 1 - start, so that the greatest has the best score and then the earliest start
    bits = 32
    fresh = np.broadcast_to((1 << bits) - 1 - np.arange(m + 1, dtype=np.int64), (k, m + 1))
    up = fresh.copy()
    steps = np.arange(m + 1, dtype=np.int64) * (-GAP << bits)
    best, end = np.zeros(k, np.int64), np.zeros(k, np.int64)
    rows = np.arange(k)
    for i in range(n):
        gain = np.where(a[:, i : i + 1] == b, MATCH, MISMATCH).astype(np.int64) << bits
        now = fresh.copy()
        now[:, 1:] = np.maximum(now[:, 1:], np.maximum(up[:, :-1] + gain, up[:, 1:] + (GAP << bits)))
        now = np.maximum.accumulate(now + steps, axis=1) - steps
        now = np.maximum(now, fresh)
        at = now.argmax(axis=1)
        top = now[rows, at]
        better = (top >> bits) > (best >> bits)
        best[better], end[better] = top[better], at[better]
        up = now
    return best >> bits, (1 << bits) - 1 - (best & ((1 << bits) - 1)), end


def best_scores(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """The scores of smith_waterman alone, in small numbers."""
    k = len(items)
    n, m = max(map(len, items), default=0), max(map(len, passages), default=0)
    kind = np.int16 if max(m, n) < 8000 else np.int32
    a, b = np.full((k, n), -1, np.int64), np.zeros((k, m), np.int64)
    for i in range(k):
        a[i, : len(items[i])] = items[i]
        b[i, : len(passages[i])] = passages[i]
    up, best = np.zeros((k, m + 1), kind), np.zeros(k, kind)
    steps = np.arange(m + 1, dtype=kind) * kind(-GAP)
    now = np.zeros((k, m + 1), kind)
    for i in range(n):
        gain = np.where(a[:, i : i + 1] == b, kind(MATCH), kind(MISMATCH))
        gain += up[:, :-1]
        np.maximum(gain, up[:, 1:] + kind(GAP), out=gain)
        np.maximum(gain, 0, out=now[:, 1:])
        now += steps
        np.maximum.accumulate(now, axis=1, out=up)
        up -= steps
        np.maximum(best, up.max(axis=1), out=best)
        now[:, 0] = 0
    return best


def align(items: Items, words: np.ndarray, doc: np.ndarray, threshold: float) -> list[tuple[int, int, int, float, int, int]]:
    """(row, item, score, share of a perfect score, start word, end word) of the passages of texts at or above the threshold."""
    found = []
    todo = sorted(candidate_windows(items, words, doc), key=lambda x: (len(items.words[x[1]]), x[3] - x[2]))
    begin = np.r_[0, np.cumsum(np.bincount(doc))]
    while todo:
        some, cells = [], 0
        while todo and (not some or cells < CELLS):
            some.append(todo.pop())
            cells += len(items.words[some[-1][1]]) * (some[-1][3] - some[-1][2])
        score = best_scores([items.words[i] for _, i, _, _ in some], [words[lo:hi].view(np.int64) for _, _, lo, hi in some])
        some = [x for x, s in zip(some, score.tolist(), strict=True) if s >= threshold * MATCH * len(items.words[x[1]])]
        score, start, end = smith_waterman([items.words[i] for _, i, _, _ in some], [words[lo:hi].view(np.int64) for _, _, lo, hi in some])
        for (r, i, lo, _), s, x, y in zip(some, score.tolist(), start.tolist(), end.tolist(), strict=True):
            share = s / (MATCH * len(items.words[i]))
            if share >= threshold:
                at = lo - int(begin[r])
                found.append((r, i, int(s), share, at + int(x), at + int(y)))
    return sorted(set(found))  # neighbouring windows may both hold a passage


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Test items (item_id, text), in blocks of at most about BLOCK_BYTES of text, each taken to the driver in turn; null texts: left out."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r.item_id, r.text.encode()) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def seed_counts(docs: DataFrame, used: np.ndarray) -> np.ndarray:
    """For each slot that items use, how often documents have a seed there. Tasks send sums: a row a used slot at most."""
    sent = docs.sparkSession.sparkContext.broadcast(used)  # 2 ** SLOT_BITS flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                words, doc = words_of(part.column(0))
                for apart in range(REACH + 1):
                    s = slot(seed_keys(words, doc, apart)[1])
                    total += np.bincount(s[sent.value[s]], minlength=len(total))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["g", "n"])

    sums = docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # a row a slot at most
    slots, n = sums.column(0).to_numpy(), sums.column(1).to_numpy()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[slots] = n
    return counts


def _searched(docs: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator:
    """A broadcast of the rare seeds of each block of items. One scan counts for all blocks."""
    used = np.zeros(1 << SLOT_BITS, bool)
    for rows in blocks(benchmark):
        used[slot(index_items(rows, threshold).keys)] = True
    counts = seed_counts(docs, used)
    for rows in blocks(benchmark):
        yield docs.sparkSession.sparkContext.broadcast(rare_seeds(index_items(rows, threshold), counts))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each passage of a document that copies a test item: doc_id, item_id, score, share, start_word, end_word, item_words.

    score: of the local alignment; share: of the item's perfect score, at least `threshold` whatever the item's size. Words are counted from 0; end_word is
    behind the passage; item_words is the item's length. Copies of an item that lie within a passage's length of each other are one row, the best one's. Null texts hold none; null ids stay null; repeated rows are found each. Texts of any length are searched
    whole; time and memory of an alignment go as the item's words times its window's (at most 16 passages). Empty tables give an empty
    result. Only doc_id and text, and item_id and text, are read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = benchmark.schema["item_id"].dataType
    result = None
    for sent in _searched(source, benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part in slices(batch):
                    ids = part.column(0).to_pylist()
                    rows = [(ids[r], items.ids[i], *rest, len(items.words[i])) for r, i, *rest in align(items, *words_of(part.column(1)), threshold)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], to) for k, to in enumerate((pa.int64(), arrow_kind, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "share", "start_word", "end_word", "item_words"])

        arrow_kind = pa.string() if kind.simpleString() == "string" else pa.int64()
        found = source.mapInArrow(run, f"doc_id long, item_id {'string' if arrow_kind == pa.string() else 'long'}, score long, share double, start_word long, end_word long, item_words long")
        result = found if result is None else result.unionAll(found)
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold a copy of a test item (see leaks); all columns stay. Nothing is shuffled."""
    text = docs.columns.index("text")
    result = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # plain names on the way, as Spark takes a dot for a field
    kinds = result.schema
    for sent in _searched(docs, benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, f"c{text}"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[x[0] for x in align(sent.value, *words_of(part.column(text)), threshold)]] = False
                    yield part.filter(pa.array(clean))

        result = result.mapInArrow(run, kinds)
    return result.toDF(*docs.columns)
