"""Language-model scores by online logistic context mixing.

A token is a sequence of bits: its Huffman code among the frequent words (the end and an escape are two of them), and after the
escape the Huffman codes of its bytes and of its end. Each bit has several predictors: the code's own odds, and counts of zeros and ones
in slots of a hashed table by context (the words before; inside a word, the bytes before and their place). Their log odds are combined by weights that a
gate (the place in the code or word) and each predictor's confidence select, learned online by each task ahead of the counts; an adaptive
map refines the result. Counts add up over tasks, so the table holds all of the corpus; weights are averaged.

The table has a fixed size; what grows with the corpus are the words' counts and the memory of passages: texts fall into segments of
about SEGMENT words at places that their words alone decide, and for the three words before a segment the whole training corpus says which
segment follows most often (a text's own occurrence left out). As segments form a prefix code, the share that such a forecast deserves, by
how often and how surely it was right, and the mixed bits give one distribution.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tokens, fold, pack_array, slices, tokens_of, unpack_array, written

#: Slots of the table of hashed contexts, of which each has its own sixteenths (a power of two): first sixteenth, their number. Codes have the first half of
#: the table, spellings the second.
SLOTS = 1 << 24
SHARES = {0: ((0, 4), (4, 4)), 1: ((8, 2), (10, 2), (12, 2), (14, 2))}
#: A task counts codes in 16 bits: both counts of a slot are halved where one is above this.
HALVED = 16_000
#: Words with a code of their own (at most so many, seen so often), and words whose counts every task holds (the most frequent ones).
CODED, CODED_LEAST = 1 << 18, 4
FREQUENT = 1 << 18
#: Parts of the table that are summed apart, and tables that are summed at once.
PARTS, FAN = 64, 16
GATES, LEVELS, STEPS, FINE = 12, 12, 48, 2049
#: Words of a segment on average and at most.
SEGMENT, LONGEST = 16, 256
#: Text that is worked on at once, and bits of a step.
SLICE = 4_000_000
STEP = 1 << 15
#: Distinct words that a task counts before it hands them on.
MOST_WORDS = 250_000
#: Spellings that a task remembers.
MOST_SPELLED = 100_000

_K1, _K2, _K64 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint64(0x9E3779B97F4A7C15)


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, nodes, bits, depths, odds): symbol s has nodes[first[s] : first[s + 1]] (inner nodes from 1, the root) and its bits; odds: of
    a one at each node, as a logarithm."""
    n = len(counts)
    heap = [(c, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.full(max(1, 2 * n - 1), -1, np.int64), np.zeros(max(1, 2 * n - 1), np.uint8)
    split = []
    for new in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        split.append((a, b))
        parent[x] = parent[y] = new
        side[y] = 1
        heapq.heappush(heap, (a + b, new))
    # all symbols go up towards the root side by side
    at, length, climbed = np.arange(n), np.zeros(n, np.int64), []
    while len(live := np.flatnonzero(parent[at] >= 0)):
        climbed.append((live, (2 * n - 1 - parent[at[live]]).astype(np.uint32), side[at[live]]))
        at[live] = parent[at[live]]
        length[live] += 1
    first = np.r_[0, np.cumsum(length)]
    nodes, bits = np.zeros(first[-1], np.uint32), np.zeros(first[-1], np.uint8)
    for up, (some, node, bit) in enumerate(climbed):
        nodes[first[some + 1] - 1 - up], bits[first[some + 1] - 1 - up] = node, bit
    depths = np.arange(first[-1]) - np.repeat(first[:-1], length)
    odds = np.array([0.0, *(np.log(b / a) for a, b in reversed(split))], np.float32)
    return first, nodes, bits, np.minimum(depths, GATES - 1), odds


def compact(code: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, steps, odds) of a code; a step is node << 5 | depth << 1 | bit, so that one look gives all three."""
    first, nodes, bits, depths, odds = code
    return first, nodes << np.uint32(5) | depths.astype(np.uint32) << np.uint32(1) | bits, odds


@dataclass
class Codes:
    """The frequent words in falling order of counts, then by word: exact counts of all, codes of the first `coded`."""

    frequent: list[bytes]
    often: np.ndarray  # their counts, and a 0 behind
    coded: int
    words: tuple  # Huffman code: 0 end, 1 escape, 2 + i the i-th word
    letters: tuple  # 256: the word's end
    train_tokens: int
    distinct: int
    ends: int

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the frequent ones, -1 for others; those before `coded` have a code."""
        if not hasattr(self, "_places"):
            self._places = {w: i for i, w in enumerate(self.frequent)}
        return np.fromiter(map(self._places.get, words, repeat(-1)), np.int64, len(words))

    def hashed(self, t: Tokens, place: np.ndarray) -> np.ndarray:
        """`word_hashes` of t, whose distinct words have these places; those of frequent words are told once."""
        if not hasattr(self, "_hashes"):
            self._hashes = hashes_of(self.frequent)
        h = np.zeros(len(place), np.uint64)
        other = np.flatnonzero(place < 0)
        h[other] = hashes_of([t.distinct[i] for i in other.tolist()])
        some = np.flatnonzero(place >= 0)
        h[some] = looked(self._hashes, place[some])
        return by_token(t, h)

    @property
    def total(self) -> float:
        return self.train_tokens + 0.5 * (self.distinct + 1)


def make_codes(frequent: list[tuple[bytes, int]], tokens: int, distinct: int, ends: int) -> Codes:
    """tokens and distinct without the ends."""
    frequent = sorted(frequent, key=lambda x: (-x[1], x[0]))
    coded = [x for x in frequent[:CODED] if x[1] >= CODED_LEAST]
    words = huffman([ends + 1, tokens - sum(c for _, c in coded) + 1] + [c for _, c in coded])
    letters = np.ones(257)
    for w, c in frequent[len(coded) :]:
        np.add.at(letters, np.frombuffer(w, np.uint8), c)
        letters[256] += c
    often = np.array([*[c for _, c in frequent], 0], np.int64)
    return Codes([w for w, _ in frequent], often, len(coded), compact(words), compact(huffman(letters.astype(np.int64).tolist())), tokens + ends, distinct + (ends > 0), ends)


def mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint32)
    for p in parts:
        h = (h ^ p) * _K1
        h ^= h >> np.uint32(15)
    return h


def symbols(t: Tokens, place: np.ndarray, codes: Codes) -> np.ndarray:
    """Each token's symbol of the word code; place: of the distinct words."""
    symbol = np.where((place >= 0) & (place < codes.coded), place + 2, 1)
    return np.where(t.number < 0, 0, symbol[t.number] if len(symbol) else 0)


def word_hashes(t: Tokens) -> np.ndarray:
    """A 64-bit hash of each token, an end's is 0."""
    return by_token(t, hashes_of(t.distinct))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def by_token(t: Tokens, h: np.ndarray) -> np.ndarray:
    return np.where(t.number < 0, np.uint64(0), h[t.number] if len(h) else np.uint64(0)).astype(np.uint64)


def word_steps(t: Tokens, codes: Codes, symbol: np.ndarray, hashes: np.ndarray) -> Iterator[tuple]:
    """(owner, nodes, slots, bits, gates) of the tokens' codes, a step at a time; owner: the token of each bit; slots: one row a hashed context."""
    own = hashes.astype(np.uint32)
    # words before, none beyond the text's start; an end is 0
    before = []
    for k in (1, 2):
        b = np.zeros(len(own), np.uint32)
        b[k:] = np.where(t.doc[k:] == t.doc[:-k], own[:-k], np.uint32(0))
        before.append(b)
    b1, b2 = before
    tag = [np.full(len(own), i, np.uint32) for i in range(1, 3)]
    contexts = [mixed(tag[0], b1), mixed(tag[1], b1, b2)]
    first = codes.words[0]
    length = np.diff(first)[symbol]
    for lo, hi in runs(length):
        n = length[lo:hi]
        owner, path = spread(first[symbol[lo:hi]], n)
        step = looked(codes.words[1], path)
        node = step >> np.uint32(5)
        yield owner + lo, node, slots_of(0, [np.repeat(c[lo:hi], n) for c in contexts], node), (step & np.uint32(1)).astype(np.uint8), (step >> np.uint32(1) & np.uint32(15)).astype(np.int64)


def letter_steps(words: list[bytes], codes: Codes) -> Iterator[tuple]:
    """(owner, nodes, slots, bits, gates) of the words' spellings, a step of whole words at a time; owner: the word of each bit."""
    for letters, place, word in lettered(words):
        yield from spelling_steps(codes, letters, place, letter_contexts(letters, place), word)


def lettered(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(letter, place in its word, word) of the words' letters and ends, a step of whole words at a time."""
    at = 0
    while at < len(words):
        to, n = at, 0
        while to < len(words) and n < STEP // 4:
            n += len(words[to]) + 1
            to += 1
        lengths = np.array([len(w) for w in words[at:to]], np.int64) + 1
        letters = np.frombuffer(b"\0".join(words[at:to]) + b"\0", np.uint8).astype(np.int64)
        ends = np.cumsum(lengths) - 1
        letters[ends] = 256
        yield letters, np.arange(len(letters)) - np.repeat(ends - lengths + 1, lengths), np.repeat(np.arange(at, to), lengths)
        at = to


def spelling_steps(codes: Codes, letters: np.ndarray, place: np.ndarray, contexts: list[np.ndarray], owner: np.ndarray) -> Iterator[tuple]:
    first = codes.letters[0]
    length = np.diff(first)[letters]
    for lo, hi in runs(length):
        n = length[lo:hi]
        step = looked(codes.letters[1], spread(first[letters[lo:hi]], n)[1])
        node = step >> np.uint32(5)
        yield np.repeat(owner[lo:hi], n), node, slots_of(1, [np.repeat(c[lo:hi], n) for c in contexts], node), (step & np.uint32(1)).astype(np.uint8), np.repeat(np.minimum(place[lo:hi], GATES - 1), n)


def told_before(letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether all letters of its word up to a letter are those of the word before it."""
    start = np.flatnonzero(place == 0)
    size = np.diff(np.r_[start, len(letters)])
    ahead = np.repeat(np.r_[0, size[:-1]], size)  # letters of the word before
    there = place < ahead
    same = np.zeros(len(letters), bool)
    at = np.flatnonzero(there)
    same[at] = letters[at] == letters[at - ahead[at]]
    other = np.cumsum(~same)
    return other == np.repeat(other[start] - ~same[start], size)


def letter_contexts(letters: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Of each letter: the two and the four before it in its word, all before it with their number, and the two before it with their place."""
    x = letters.astype(np.uint32) + np.uint32(1)
    prev = []
    for k in range(1, 5):
        p = np.zeros(len(x), np.uint32)
        p[k:] = np.where(place[k:] >= k, x[:-k], np.uint32(0))
        prev.append(p)
    # all before: a sum of letters times powers of an odd number, from the word's start
    power = np.cumprod(np.full(int(place.max()) + 1, 0x01000193, np.uint32), dtype=np.uint32)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum((x * _K2) ^ (x >> np.uint32(3)) * power[place], dtype=np.uint32)])
    i = np.arange(len(x))
    front = sums[i] - sums[i - place]
    a, b, c, d = prev
    tag = [np.full(len(x), i, np.uint32) for i in range(11, 15)]
    ab = mixed(a, b)
    return [mixed(tag[0], ab), mixed(tag[1], ab, c, d), mixed(tag[2], front, place.astype(np.uint32)), mixed(tag[3], ab, np.minimum(place, 15).astype(np.uint32))]


def looked(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at]; at must lie within the table. Without numpy's check of each place, which takes longer than the look itself."""
    return table.take(at, mode="clip")


def runs(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about STEP bits."""
    ends = np.cumsum(length)
    lo = 0
    while lo < len(length):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
        yield lo, hi
        lo = hi


def spread(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start + 0, 1, ... length - 1) of each row."""
    own = np.repeat(np.arange(len(length)), length)
    ends = np.cumsum(length)
    return own, np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def slots_of(kind: int, contexts: list[np.ndarray], node: np.ndarray) -> np.ndarray:
    """The slots of a node in each context, one row a context."""
    out = np.empty((len(contexts), len(node)), np.int64)
    salt = node * _K2
    for row, c, (first, n) in zip(out, contexts, SHARES[kind], strict=True):
        h = (c ^ salt) * _K1
        h ^= h >> np.uint32(15)
        h *= _K2
        h >>= np.uint32(33 - (n * (SLOTS // 16)).bit_length())
        np.add(h, np.uint32(first * (SLOTS // 16)), out=row)
    return out


@dataclass
class Mixer:
    """Weights by kind, gate, predictor and confidence; and the refining map by kind, gate and step of the mixed log odds."""

    weights: list[np.ndarray]
    ones: np.ndarray
    seen: np.ndarray

    @staticmethod
    def new() -> Mixer:
        # trust grows with confidence; the code's own odds count whole
        trust = np.arange(LEVELS) / LEVELS
        w = []
        for shares in ((0.3, 0.3), (0.3, 0.4, 0.5, 0.5)):
            w.append(np.concatenate([np.ones((GATES, 1, LEVELS)), np.tile(np.array(shares)[None, :, None] * trust, (GATES, 1, 1))], axis=1))
        return Mixer(w, np.zeros((2, GATES, STEPS)), np.zeros((2, GATES, STEPS)))

    def mix(self, kind: int, odds: list[np.ndarray], level: list[np.ndarray], gate: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Mixed log odds, and where each predictor's weights are; level: as `counted` gives it."""
        flat = self.weights[kind].ravel().astype(np.float32)
        base = gate * (len(odds) * LEVELS)
        where = [base + at for at in level]
        total = np.zeros(len(gate), np.float32)
        for x, at in zip(odds, where, strict=True):
            total += looked(flat, at) * x
        return np.clip(total, -11, 11, out=total), where

    def step(self, total: np.ndarray) -> np.ndarray:
        """Of mixed log odds, which lie from -11 to 11."""
        return ((total + 12) * (STEPS / 24)).astype(np.int64)

    def refined(self, kind: int, total: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mixed one and of what such ones turned out to be, between two steps."""
        p = 1 / (1 + np.exp(-total))
        rate = (self.ones[kind] + 20 / (1 + np.exp(-(np.arange(STEPS) + 0.5) * (24 / STEPS) + 12))) / (self.seen[kind] + 20)
        place = np.clip((total + 12) * (STEPS / 24) - 0.5, 0, STEPS - 2)
        at = place.astype(np.int64)
        share, rate = place - at, rate.astype(np.float32)
        return np.clip((p + rate[gate, at] * (1 - share) + rate[gate, at + 1] * share) / 2, 1e-6, 1 - 1e-6)

    def learn(self, kind: int, odds: list[np.ndarray], total: np.ndarray, where: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, weight: np.ndarray | None) -> None:
        p = 1 / (1 + np.exp(-total))
        err, curve = bit - p, p * (1 - p)
        if weight is not None:
            err, curve = err * weight, curve * weight
        flat = self.weights[kind].reshape(-1)
        for x, at in zip(odds, where, strict=True):
            g, c = np.bincount(at, err * x, len(flat)), np.bincount(at, curve * x * x, len(flat))
            flat += np.clip(0.5 / len(odds) * g / (c + 50), -0.1, 0.1)
        cell = (gate * STEPS + self.step(total)) * 2 + bit
        both = np.bincount(cell, weight, 2 * GATES * STEPS).reshape(GATES, STEPS, 2)
        self.ones[kind] += both[:, :, 1]
        self.seen[kind] += both.sum(axis=2)


#: The confidence of a count: one more than the whole part of its binary logarithm.
LEVEL = np.minimum(np.frexp(np.arange(1 << LEVELS))[1], LEVELS - 1).astype(np.int64)


def new_counts(kind: int) -> np.ndarray:
    """Zeros and ones, in turn, of each slot of a kind: 16 bits for codes, which every task counts in millions, 32 for spellings."""
    return np.zeros(SLOTS, np.uint16 if kind == 0 else np.int32)


def odds_of(value: np.ndarray) -> np.ndarray:
    """The log odds that packed values stand for, by their upper 12 bits."""
    x = (value >> np.uint16(4)).astype(np.float32)
    x -= np.float32(2048)
    x *= np.float32(24 / 4096)
    return x


def packed(counts: np.ndarray) -> np.ndarray:
    """Of each slot of counts (zeros, ones, zeros, ...): log odds of a one << 4 | confidence."""
    c = counts.reshape(-1, 2)
    odds = np.log((c[:, 1] + 0.2) / (c[:, 0] + 0.2))
    level = LEVEL[np.minimum(c[:, 0] + c[:, 1], len(LEVEL) - 1)]
    return (np.clip(np.rint(odds * (4096 / 24)) + 2048, 0, 4095).astype(np.uint16) << 4) | level.astype(np.uint16)


def counted(own: np.ndarray, node: np.ndarray, counts: np.ndarray, places: np.ndarray, more: np.ndarray) -> tuple[list[np.ndarray], list]:
    """Log odds of each predictor, the code's own odds first, then those of places in a kind's counts; and their confidence, as its place among the
    predictors' weights. Behind that, slots of 16 bits with a large count are halved, and `more` is added while the slots are near in memory."""
    odds, level = [looked(own, node)], [LEVELS - 1]
    small = counts.dtype == np.uint16
    pairs = both_counts(counts)
    for i, row in enumerate(places, 1):
        pair = looked(pairs, row)
        zeros, ones = (pair & np.uint32(0xFFFF), pair >> np.uint32(16)) if small else (pair.astype(np.uint32), (pair >> np.uint64(32)).astype(np.uint32))
        odds.append(log_odds(zeros, ones))
        level.append(looked(LEVEL + i * LEVELS, np.minimum(zeros + ones, np.uint32(len(LEVEL) - 1))))
        if small and max(int(zeros.max()), int(ones.max())) > HALVED:
            large = np.unique(row[np.maximum(zeros, ones) > HALVED])
            both = counts.reshape(-1, 2)
            both[large] = (both[large] + np.uint16(1)) >> np.uint16(1)
        np.add.at(pairs, row, more)
    return odds, level


def both_counts(counts: np.ndarray) -> np.ndarray:
    """Zeros and ones of a slot as one number, ones in its upper half."""
    return counts.view(np.uint32 if counts.dtype == np.uint16 else np.uint64)


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    x, y = ones.astype(np.float32), zeros.astype(np.float32)
    x += np.float32(0.2)
    y += np.float32(0.2)
    x /= y
    return np.log(x, out=x)


def counted_words(docs: DataFrame) -> DataFrame:
    """word, c over all texts; tasks add up what they have first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        have: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(have), pa.binary()), pa.array(list(have.values()), pa.int64())], names=["word", "c"])
            have.clear()
            return b

        for batch in batches:
            for part in slices(batch, most=SLICE):
                t = tokens_of(part.column(0))
                n = np.bincount(t.number[t.number >= 0], minlength=len(t.distinct))
                for w, c in zip(t.distinct, n.tolist(), strict=True):
                    have[w] = have.get(w, 0) + c
                if len(have) > MOST_WORDS:
                    yield out()
        if have:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def find_codes(vocabulary: DataFrame, ends: int) -> tuple[Codes, int]:
    """Codes, and the least count of the frequent words: at most FREQUENT, whole ranges of counts."""
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # counts of counts up to 4096 and of ranges beyond: a bounded table
    by = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 4096 - 12 * 64)
    sizes = sorted(((r.b, r.n, r.least) for r in vocabulary.groupBy(by.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    least, n = 1 << 62, 0
    for _, k, c in sizes:
        if n + k > FREQUENT:
            break
        n, least = n + k, c
    frequent = [(bytes(r.word), r.c) for r in vocabulary.where(F.col("c") >= least).collect()]  # at most FREQUENT
    return make_codes(frequent, tokens, distinct, ends), least


def learned(steps: Iterator[tuple], kind: int, own: np.ndarray, counts: np.ndarray, mixer: Mixer, weights: np.ndarray | None = None) -> int:
    """Predicts each step's bits, refines the mixer and counts them in a kind's counts, each as often as its owner's weight (else once). Returns their number."""
    n, first = 0, kind * (SLOTS // 2)
    wide = both_counts(counts).dtype
    each = np.array([1, 1 << 4 * wide.itemsize], wide)  # a zero, a one
    for owner, node, slots, bit, gate in steps:
        places = slots - first if first else slots
        often = None if weights is None else weights[owner]
        more = looked(each, bit)
        if often is not None:
            more *= often.astype(wide)
        odds, level = counted(own, node, counts, places, more)
        total, where = mixer.mix(kind, odds, level, gate)
        mixer.learn(kind, odds, total, where, gate, bit, often)
        n += len(owner)
    return n


def handed_on(counts: np.ndarray, mixer: Mixer, kind: int, seen: int) -> Iterator[pa.RecordBatch]:
    """A task's counts of a kind, half of the PARTS parts, and its mixer's share, times the bits it was refined on."""
    task, each = TaskContext.get().partitionId(), 2 * SLOTS // PARTS
    for p in range(PARTS // 2):
        mine = counts[p * each : (p + 1) * each]
        if mine.any():
            yield pa.RecordBatch.from_arrays([pa.array([kind * (PARTS // 2) + p]), pa.array([task]), pa.array([pack_array(mine)], pa.binary())], names=["part", "task", "data"])
    scale = max(1, seen)
    flat = np.concatenate([[scale], mixer.weights[kind].ravel() * scale, mixer.ones[kind].ravel(), mixer.seen[kind].ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([PARTS + kind]), pa.array([task]), pa.array([pack_array(flat)], pa.binary())], names=["part", "task", "data"])


def unpacked(part: int, data: bytes) -> np.ndarray:
    """Counts as long integers, or a mixer's share."""
    if part >= PARTS:
        return unpack_array(data, np.float64)
    x = unpack_array(data, np.int8)
    return x.view({2: np.uint16, 4: np.int32, 8: np.int64}[len(x) // (2 * SLOTS // PARTS)]).astype(np.int64)


def train(docs: DataFrame, vocabulary: DataFrame, codes: Codes) -> tuple[np.ndarray, Mixer]:
    """The packed table and the mixer: codes learned from all texts of docs, spellings from all words of the vocabulary by their counts.

    Each task predicts what it reads by what it has seen, learns its weights from that, and counts. Tables are summed part by part, FAN
    tasks at a time, so that no task gets more than FAN parts however many tasks there are; one table comes to the driver.
    """
    sent = docs.sparkSession.sparkContext.broadcast(codes)  # FREQUENT words at most

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts, mixer, seen = new_counts(0), Mixer.new(), 0
        for batch in batches:
            for part in slices(batch, most=SLICE):
                t = tokens_of(part.column(0))
                place = sent.value.places(t.distinct)
                seen += learned(word_steps(t, sent.value, symbols(t, place, sent.value), sent.value.hashed(t, place)), 0, sent.value.words[2], counts, mixer)
        if seen:
            yield from handed_on(counts, mixer, 0, seen)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts, mixer, seen = new_counts(1), Mixer.new(), 0
        for batch in batches:
            words, often = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64)
            place = sent.value.places(words)
            keep = (place < 0) | (place >= sent.value.coded)
            words, often = [w for w, k in zip(words, keep.tolist(), strict=True) if k], often[keep]
            seen += learned(letter_steps(words, sent.value), 1, sent.value.letters[2], counts, mixer, often)
        if seen:
            yield from handed_on(counts, mixer, 1, seen)

    def sums(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        forget()
        have: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, task, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = unpacked(part, data)
                have[part, task] = have[part, task] + x if (part, task) in have else x
        for (part, task), x in have.items():
            # the driver gets two bytes a slot, not counts
            x = packed(x) if last and part < PARTS else x
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([task]), pa.array([pack_array(x)], pa.binary())], names=["part", "task", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sums(batches, False)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sums(batches, True)

    out = "part long, task long, data binary"
    # a task over the vocabulary has a table of its own to hand on, so a few large tasks are better than many small ones
    words = vocabulary.select("word", "c")
    words = words.coalesce(max(1, words.rdd.getNumPartitions() // 4))
    both = docs.select("text").mapInArrow(of_texts, out).unionAll(words.mapInArrow(of_words, out))
    tasks = docs.rdd.getNumPartitions() + words.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // FAN)
        both = both.withColumn("task", F.floor(F.col("task") / FAN)).repartition(PARTS * min(tasks, 64), "part", "task").mapInArrow(told if tasks == 1 else summed, out)
        if tasks == 1:
            break
    table, mixer = np.empty(SLOTS, np.uint16), Mixer.new()
    each = SLOTS // PARTS
    table[:] = packed(np.zeros(2, np.int64))[0]  # nothing counted
    for r in both.collect():  # a row a part, two bytes a slot
        if r.part < PARTS:
            table[r.part * each : (r.part + 1) * each] = unpack_array(bytes(r.data), np.uint16)
        else:
            x = unpacked(r.part, bytes(r.data))
            kind, w = r.part - PARTS, mixer.weights[r.part - PARTS]
            mixer.weights[kind] = (x[1 : 1 + w.size] / x[0]).reshape(w.shape)
            mixer.ones[kind], mixer.seen[kind] = x[1 + w.size :].reshape(2, GATES, STEPS)
    return table, mixer


def cost_tables(mixer: Mixer) -> list[np.ndarray]:
    """For each kind, log10 of the probability of a bit by gate, bit and mixed log odds in FINE steps from -11 to 11."""
    total = np.linspace(-11, 11, FINE).astype(np.float32)
    out = []
    for kind in (0, 1):
        p = np.stack([mixer.refined(kind, total, np.full(FINE, g)) for g in range(GATES)])
        out.append(np.log10(np.stack([1 - p, p], axis=1)).ravel())
    return out


def step_costs(steps: Iterator[tuple], kind: int, n: int, own: np.ndarray, table: np.ndarray, mixer: Mixer, costs: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each of n owners' bits."""
    cost = np.zeros(n)
    # by predictor: weights by gate << 4 | confidence
    weights = np.zeros((mixer.weights[kind].shape[1], GATES, 16), np.float32)
    weights[:, :, :LEVELS] = mixer.weights[kind].transpose(1, 0, 2)
    sure = weights[0, :, LEVELS - 1].copy()
    weights = weights.reshape(len(weights), -1)[1:]
    for owner, node, slots, bit, gate in steps:
        total = looked(sure, gate)
        total *= looked(own, node)
        base = gate << 4
        for w, row in zip(weights, slots, strict=True):
            v = looked(table, row)
            total += looked(w, base + (v & np.uint16(15))) * odds_of(v)
        np.clip(total, -11, 11, out=total)
        total += np.float32(11)
        total *= np.float32((FINE - 1) / 22)
        at = np.rint(total, out=total).astype(np.int64)
        at += (gate * 2 + bit) * FINE
        lo = int(owner[0])
        sums = np.bincount(owner - lo, looked(costs[kind], at))
        cost[lo : lo + len(sums)] += sums
    return cost


class Costs:
    """Costs of tokens by a model. Words that are spelled often are remembered."""

    def __init__(self, codes: Codes, table: np.ndarray, mixer: Mixer):
        self.codes, self.table, self.mixer, self.bits = codes, table, mixer, cost_tables(mixer)
        self.spelled: dict[bytes, float] = {}

    def spelling(self, words: list[bytes]) -> np.ndarray:
        """Of whole spellings. What a word shares with the word before it in order is told once."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out = np.zeros(len(words))
        for letters, place, word in lettered([words[i] for i in order]):
            new = ~told_before(letters, place)
            own = np.flatnonzero(new)
            steps = spelling_steps(self.codes, letters[own], place[own], [c[own] for c in letter_contexts(letters, place)], np.arange(len(own)))
            cost = step_costs(steps, 1, len(own), self.codes.letters[2], self.table, self.mixer, self.bits)
            # place by place, a letter has the cost of the last one told
            row = np.argsort(place, kind="stable")
            full = np.empty(len(place))
            full[row] = cost[(np.cumsum(new) - 1)[row[np.maximum.accumulate(np.where(new[row], np.arange(len(row)), 0))]]]
            lo = int(word[0])
            sums = np.bincount(word - lo, full)
            out[lo : lo + len(sums)] = sums
        back = np.empty(len(words))
        back[order] = out
        return back

    def of(self, t: Tokens, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """log10 of each token's probability."""
        symbol = symbols(t, place, self.codes)
        cost = step_costs(word_steps(t, self.codes, symbol, hashes), 0, len(t.number), self.codes.words[2], self.table, self.mixer, self.bits)
        other = np.flatnonzero((place < 0) | (place >= self.codes.coded)).tolist()
        own = np.zeros(len(t.distinct))
        new = []
        for i in other:
            found = self.spelled.get(t.distinct[i])
            if found is None:
                new.append(i)
            else:
                own[i] = found
        words = [t.distinct[i] for i in new]
        own[new] = self.spelling(words)
        if len(self.spelled) + len(new) > MOST_SPELLED:
            self.spelled.clear()
        if len(new) <= MOST_SPELLED:
            self.spelled.update(zip(words, own[new].tolist(), strict=True))
        return cost + np.where(t.number < 0, 0, own[t.number] if len(own) else 0)


def segments(t: Tokens, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, key, segment) of the segments: tokens first to end - 1, hashes of the three words before and of the segment.

    One begins behind each pair of words that a hash picks, if the text has three words there, and goes on up to such a pair, the text's end
    or LONGEST tokens.
    """
    n = len(hashes)
    if n < 4:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    pair = ((hashes[1:] * _K64) ^ hashes[:-1]) * _K64
    at = np.flatnonzero((pair >> np.uint64(40)) % np.uint64(SEGMENT) == 0) + 1
    at = at[(at >= 2)]
    at = at[(t.doc[at] == t.doc[at - 2]) & (t.number[at] >= 0)]
    ends = np.flatnonzero(t.number < 0)
    stop = np.minimum(np.minimum(np.r_[at[1:], n], ends[t.doc[at]]), at + LONGEST)
    key = (((hashes[at - 2] * _K64) ^ hashes[at - 1]) * _K64 ^ hashes[at]) * _K64
    own, token = spread(at + 1, stop - at)
    x = (hashes[token] ^ np.uint64(1)) * _K64
    x = ((x ^ (x >> np.uint64(29))) + (token - at[own]).astype(np.uint64)) * _K64
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(32)), dtype=np.uint64)]
    edge = np.r_[0, np.cumsum(stop - at)]
    return at + 1, stop + 1, key.view(np.int64), (sums[edge[1:]] - sums[edge[:-1]]).view(np.int64)


_costs: list = [None, None]


def forget() -> None:
    """A worker that scored by an earlier model lets go of it before it counts or learns."""
    _costs[:] = None, None


def costs_of(sent, model: str) -> Costs:
    """One instance a process and model."""
    if _costs[0] != model:
        forget()  # never two at once
        _costs[:] = model, Costs(*sent.value)
    return _costs[1]


#: Classes of forecasts: how often the segment was seen (1, 2, 3-4, ... beyond 16), and in which share of the places, in quarters.
OFTEN, SURE = 6, 5


def forecast_class(seen: Column, places: Column) -> Column:
    return F.least(F.floor(F.log2(seen.cast("double")) - 1e-9) + 1, F.lit(OFTEN - 1)).cast("int") * SURE + F.floor(4 * seen / places).cast("int")


def forecasts(passages: DataFrame) -> tuple[DataFrame, list[float]]:
    """(key, segment, seen, places) of the segment that most often follows the three words of key in passages(key, segment), and each class's
    share of right ones, every training passage told by the others."""
    counted = passages.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("key").agg(F.max(F.struct("n", "segment")).alias("x"), F.sum("n").alias("places"))
    best = written(best.select("key", F.col("x.segment").alias("segment"), F.col("x.n").alias("seen"), "places"))
    # a passage that is the best one of its key lacks itself, another one is missed
    right = best.where("seen > 1").select(forecast_class(F.col("seen") - 1, F.col("places") - 1).alias("k"), F.col("seen").alias("right"), F.lit(0).alias("wrong"))
    wrong = best.where("places > seen").select(forecast_class(F.col("seen"), F.col("places") - 1).alias("k"), F.lit(0).alias("right"), (F.col("places") - F.col("seen")).alias("wrong"))
    share = [0.1] * (OFTEN * SURE)
    for r in right.unionAll(wrong).groupBy("k").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong")).collect():  # a row a class
        share[r.k] = min(0.999, (r.right + 0.1) / (r.right + r.wrong + 1))
    return best, share


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, mixed_score.

    Learns from documents whose crc32(doc_id as text) mod 5 is not 1. Null and empty texts are one token, the end; null ids are learned
    from. Repeated rows each get a row. bits_per_byte: of the UTF-8 text with one byte for its end; mixed_score: the score without
    forecasts of whole passages. Without training documents base_score is that of unseen tokens. An empty table gives an empty result.
    Texts of any length are scored whole, one at a time beyond SLICE bytes.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = source.where(fold(F.col("doc_id"), 5) != 1)
    vocabulary = written(counted_words(training))
    codes, least = find_codes(vocabulary, training.count())
    model = uuid4().hex
    sent = spark.sparkContext.broadcast((codes, *train(training, vocabulary, codes)))  # FREQUENT words and SLOTS slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = costs_of(sent, model)
        codes = costs.codes
        row = TaskContext.get().partitionId() << 33
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64(), "word": pa.binary(), "rows": pa.list_(pa.int64()), "times": pa.list_(pa.int32()), "key": pa.int64(), "segment": pa.int64(), "held": pa.bool_()}

        def made(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) if k in columns and not isinstance(columns[k], pa.Array) else columns.get(k, pa.nulls(n, kind)) for k, kind in kinds.items()], names=list(kinds))

        for batch in batches:
            for part in slices(batch, most=SLICE):
                t = tokens_of(part.column(1))
                n = part.num_rows
                place = codes.places(t.distinct)
                hashes = codes.hashed(t, place)
                cost = costs.of(t, place, hashes)
                counts = codes.often[place]  # -1: the last one, 0
                c = np.where(t.number < 0, codes.ends, counts[t.number] if len(counts) else 0)
                sure = (c > 0) | (t.number < 0)
                base = np.bincount(t.doc[sure], np.log10((c[sure] + 0.5) / codes.total), n)
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield made(row=row + np.arange(n), doc_id=part.column(0), n_tokens=np.bincount(t.doc, minlength=n), n_known=np.bincount(t.doc[c > 0], minlength=n), base_score=base, score=np.bincount(t.doc, cost, n), n_bytes=size)
                first, end, key, segment = segments(t, hashes)
                if len(first):
                    sums = np.r_[0, np.cumsum(cost)]
                    held = part.column(2).to_numpy(zero_copy_only=False)[t.doc[first]]
                    yield made(row=row + t.doc[first], key=key, segment=segment, score=sums[end] - sums[first], held=held)
                # other words: once for each, with the rows that have it and how often
                rest = np.flatnonzero(~sure)
                if len(rest):
                    pair, times = np.unique(t.number[rest] * n + t.doc[rest], return_counts=True)
                    word, at = pair // n, pair % n
                    offsets = np.r_[0, np.flatnonzero(np.diff(word)) + 1, len(word)].astype(np.int32)
                    yield made(word=[t.distinct[i] for i in word[offsets[:-1]]], rows=pa.ListArray.from_arrays(offsets, pa.array(row + at)), times=pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))))
                row += n

    kinds = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long, word binary, rows array<long>, times array<int>, key long, segment long, held boolean"
    passed = written(source.withColumn("held", fold(F.col("doc_id"), 5) == 1).mapInArrow(run, kinds))
    # counts of the other words
    value = F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.5)) / F.lit(codes.total))
    met = passed.where("word IS NOT NULL").select("word", "rows", "times").join(vocabulary.where(F.col("c") < least), "word", "left")
    others = met.select(F.explode(F.arrays_zip("rows", "times")).alias("x"), value.alias("v"), F.col("c").isNotNull().cast("long").alias("k"))
    others = others.select(F.col("x.rows").alias("row"), (F.col("x.times") * F.col("v")).alias("b"), (F.col("x.times") * F.col("k")).alias("m"), F.lit(None).cast("double").alias("s"))
    # what forecasts change
    told = passed.where("key IS NOT NULL").select("row", "key", F.col("segment").alias("own"), F.col("score").alias("cost"), "held")
    best, share = forecasts(told.where("NOT held").select("key", F.col("own").alias("segment")))
    itself = F.when(F.col("held"), 0).otherwise(1)
    hit = F.col("own") == F.col("segment")
    told = told.join(best, "key").select("row", "cost", hit.alias("hit"), (F.col("seen") - F.when(hit, itself).otherwise(0)).alias("seen"), (F.col("places") - itself).alias("places")).where("seen > 0")
    given = F.element_at(F.array(*[F.lit(x) for x in share]), forecast_class(F.col("seen"), F.col("places")) + 1)
    gain = F.when(F.col("hit"), F.log10(given + (1 - given) * F.pow(F.lit(10.0), F.col("cost"))) - F.col("cost")).otherwise(F.log10(1 - given))
    told = told.select("row", F.lit(None).cast("double").alias("b"), F.lit(None).cast("long").alias("m"), gain.alias("s"))
    extra = others.unionAll(told).groupBy("row").agg(F.sum("b").alias("b"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    scored = F.col("score") + F.coalesce("s", F.lit(0.0))
    return passed.where("n_tokens IS NOT NULL").select("row", "doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes").join(extra, "row", "left").select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 1).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("m", F.lit(0))).alias("n_known"),
        F.lit(codes.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        scored.alias("score"),
        (-scored * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        F.col("score").alias("mixed_score"),
    )
