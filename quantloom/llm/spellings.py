"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by merging an errata trie.

The trie of all words is cut into heavy paths: at each node the child with the most words below is heavy, the others, and a word that ends there, are light.
Light subtrees are merged into what stands beside them, the smaller into the larger, with one character skipped, replaced by the heavy one, or set before them;
two light ones meet with their first characters left out. Where the end of a merged word falls on the end of another, the two are one edit apart, and each such
pair comes up once, at the node where its words part. A word lies in at most log2(words) light subtrees, so that merging sends few rows a word.

A node is the hash of its path, counts of its children are sums of a shuffle, and merged ends meet by a join, so nothing of the trie is in one place. If two
nodes share a hash they share their heavy child as well, which adds rows and loses no pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32, dropped, slices, written

LEAST_LENGTH, LEAST_COUNT, ERRATA, TIMES = 7, 2, 31, 10

_K = np.uint64(0x9E3779B97F4A7C15)

#: Steps that one Arrow batch holds.
STEPS = 1_000_000


def spelled_words(docs: DataFrame, least_length: int = LEAST_LENGTH, errata: int = ERRATA) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF in all texts, A-Z lower-cased, of at least least_length code points, and how often each occurs.

    Where `errata` divides the crc32 of "doc_id:run", one code point is left out. A null id counts as empty text.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found: Counter[str] = Counter()
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    # bytes lower only A-Z
                    for word, n in Counter(runs.findall((text or b"").lower().decode())).items():
                        h = crc32(f"{'' if i is None else i}:{word}".encode())
                        if h % errata == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        found[word] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def path_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, at, node) of each step of each word, the end included: node is the hash of the code points before it."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size + 1)
    owner = np.repeat(np.arange(len(words)), size + 1)
    at = np.arange(int(ends[-1])) - (ends - size - 1)[owner]
    power = np.ones(int(size.max()) + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _K))
    value = np.zeros(len(at), np.uint64)
    value[at < size[owner]] = points + np.uint64(1)
    value *= power[at]
    before = np.cumsum(value, dtype=np.uint64) - value
    node = before - before[ends - size - 1][owner]
    node = (node ^ at.astype(np.uint64)) * _K
    return owner, at, (node ^ (node >> np.uint64(29))).view(np.int64)


def steps(words: DataFrame) -> DataFrame:
    """(id, at, node, ch, then) of words(id, word): the node before each code point and before the end, and the next code point and the one after, "" at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", STEPS):
                ids, own = part.column(0), part.column(1).to_pylist()
                owner, at, node = path_hashes(own)
                size = np.array([len(w) for w in own], np.int64)
                chars = np.full(len(at) + 1, "", dtype="<U1")
                points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
                chars[:-1][at < size[owner]] = points.view("<U1")
                then = np.where(at < size[owner], chars[1:], "")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(at, pa.int32()), pa.array(node), pa.array(chars[:-1], pa.string()), pa.array(then, pa.string())], names=["id", "at", "node", "ch", "then"])

    return words.select("id", "word").mapInArrow(run, "id long, at int, node long, ch string, then string")


def light_steps(words: DataFrame) -> DataFrame:
    """(id, at, ch, then, heavy): where a word of words(id, word) goes down a light edge, or ends, beside a heavy child."""
    path = steps(words)
    counts = path.groupBy("node", "ch").agg(F.count(F.lit(1)).alias("c"))
    best = F.max(F.struct(F.col("ch") != "", "c", "ch"))  # the end of a word is never the heavy child
    # a table of its own, so that the join stands between two exchanges and adaptive execution can split the topmost nodes
    heavy = written(counts.groupBy("node").agg(best.alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1").select("node", F.col("x.ch").alias("heavy")))
    return path.join(heavy, "node").where("ch != heavy").select("id", "at", "ch", "then", "heavy")


def near_words(words: DataFrame, light: DataFrame) -> DataFrame:
    """(word, n_near, best): of words(id, word, n), ids and words unique, each that has near ones, how many, and (-n, word) of the best: most frequent, then least.

    Near words differ by exactly one inserted, deleted or replaced code point. light: of `light_steps`.
    """
    merged = light.join(words, "id").withColumns({"head": F.expr("substring(word, 1, at)"), "tail": F.expr("substring(word, at + 1)"), "rest": F.expr("substring(word, at + 2)")})
    # the light word merged into its siblings or the heavy path, with one character skipped, replaced or set before
    skipped = F.when((F.col("ch") != "") & (F.col("then") != F.col("ch")), F.concat("head", "rest"))
    replaced = F.when(F.col("ch") != "", F.concat("head", "heavy", "rest"))
    before = F.concat("head", "heavy", "tail")
    sent = merged.select("word", "n", F.explode(F.array(skipped, replaced, before)).alias("target")).where("target IS NOT NULL")
    met = sent.join(words.select(F.col("word").alias("target"), F.col("n").alias("m")), "target")
    one = F.lit(1).cast("long").alias("near")
    there = met.select("word", one, F.struct((-F.col("m")).alias("n"), F.col("target").alias("word")).alias("best"))
    back = met.select(F.col("target").alias("word"), one, F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("best"))
    # light siblings whose words are alike behind their first characters: all are near each other, at most one for each character there is
    own = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    group = Window.partitionBy("at", "head", "rest")
    order = group.orderBy(own)
    level = merged.where("ch != ''").select("word", "n", "at", "head", "rest").withColumns({"own": own}).withColumns({"k": F.count(F.lit(1)).over(group), "first": F.first("own").over(order), "second": F.lead("own").over(order)})
    level = level.where("k > 1").select("word", (F.col("k") - 1).alias("near"), F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    return there.unionAll(back).unionAll(level).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, largest: int, times: int) -> DataFrame:
    """(word, root): forms(word, form) followed to the last. n grows `times`-fold with each step and ends at `largest`, so that a few doublings reach it."""
    now, longest = written(forms.select("word", F.col("form").alias("root"))), 0
    while times ** (longest + 1) <= max(largest, 1):
        longest += 1
    reach = 1
    while reach < longest:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        dropped(now)
        now, reach = further, 2 * reach
    return now


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, errata: int = ERRATA, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word of docs(doc_id, text) that occurs often enough, its usual form, and what following forms leads to.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least `times` its own n, else null. Null texts and texts
    without words give nothing; repeated rows count each; no words, no rows.
    """
    counted = spelled_words(docs, least_length, errata).where(F.col("n") >= least_count)
    words = written(counted.withColumn("id", F.monotonically_increasing_id()))
    light = written(light_steps(words))
    found = words.join(near_words(words, light), "word", "left")
    takes = -F.col("best.n") >= times * F.col("n")
    found = written(found.select("word", F.when(takes, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("best.n")).alias("form_n")))
    dropped(words, light)
    largest = found.agg(F.max("n")).first()[0]
    last = roots(found.where("form IS NOT NULL"), largest or 0, times)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
