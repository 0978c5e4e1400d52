"""License scans: an exact containment join of text blocks with license templates.

A template is a set of t words; a block of a text is any run of as many words as the template has and half as many again. A block meets the template if it holds
at least the share `least` of its distinct words, a = ceil(least * t). The words of all templates are ordered by how often the corpus has them, rarest first. Then
  prefix: a block that meets the template holds one of its t - a + 1 rarest words, so the join looks up only these;
  length: a block with fewer than a of the template's words is left out before distinct ones are counted;
  position: if the rarest word that they share is the i-th of the template (from 0), they share at most t - i.
What is left is counted exactly. Any order gives the same result. Templates are a fixed, small table that every task has.

Phrases are templates of which a block of their own length must hold all words, in their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import schema, slices, tokens_of, with_columns

#: Words are runs of digits, letters and code points beyond ASCII; A-Z are lower-cased.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    """least: the share of distinct words, in percent, that a block must hold. must: words that it must hold; never: words that it must not.
    ordered: the block has the template's length and its words in its order."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    least: int = 80
    ordered: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def needed(self) -> int:
        return -(-self.least * len(set(self.words)) // 100)

    @property
    def block(self) -> int:
        return len(self.words) if self.ordered else math.ceil(1.5 * len(self.words))


# Phrases and license texts (fixed values), lower-case, words between blanks.
PHRASES = [
    Template("mit", "under the mit license", least=100, ordered=True),
    Template("apache-2", "apache license version 2", least=100, ordered=True),
    Template("cc-by-nc", "cc by nc", least=100, ordered=True),
]
LICENSES = [
    Template("mit", "released under the mit license", ("mit", "license")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("sublicense",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache", "license", "2")),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache", "compliance")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "by", "nc")),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative", "commons", "noncommercial")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc", "by", "sa")),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("creative", "commons", "sharealike"), ("noncommercial",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived", "neighboring")),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu", "general", "3"), ("lesser", "affero", "library")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu", "general", "2"), ("lesser", "affero", "library")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu", "general", "redistribute"), ("lesser", "affero", "library")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu", "lesser")),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu", "affero")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution", "binary")),
    Template("bsd", "released under the bsd 3 clause license", ("bsd", "license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("fee", "granted")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered", "domain")),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse",)),
]

FOUND = "array<struct<label:string,start:long,length:long,share:double,ordered:boolean>>"


def word_counts(docs: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """How often the corpus has each of the words, one row a word."""
    number = {w.encode(): i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for part in slices(batch):
                t = tokens_of(part.column(0), LETTERS)
                own = np.array([number.get(w, -1) for w in t.distinct] + [-1])[t.number]
                total += np.bincount(own[own >= 0], minlength=len(number))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["i", "c"])

    got = {r.i: r.c for r in docs.select("text").mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()}
    return {w: got.get(i, 0) for i, w in enumerate(words)}


class Scanner:
    """Templates with their words in the order of `counts`, rarest first."""

    def __init__(self, templates: Sequence[Template], counts: dict[str, int]):
        self.templates = list(templates)
        vocabulary = sorted({w for t in templates for w in (*t.words, *t.must, *t.never)}, key=lambda w: (counts.get(w, 0), w))
        self.number = {w.encode(): i for i, w in enumerate(vocabulary)}
        n = len(vocabulary)

        def marked(words: Sequence[str]) -> np.ndarray:
            out = np.zeros(n + 1, bool)  # the last: all other words
            out[[self.number[w.encode()] for w in words]] = True
            return out

        self.own = [marked(t.words) for t in templates]
        self.prefix = [marked([]) for _ in templates]
        for p, own, t in zip(self.prefix, self.own, templates, strict=True):
            order = np.flatnonzero(own)
            p[order[: len(order) - t.needed + 1]] = True
        self.must = [np.array([self.number[w.encode()] for w in t.must], int) for t in templates]
        self.never = [marked(t.never) for t in templates]
        self.order = [np.array([self.number[w.encode()] for w in t.words]) for t in templates]

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """The number of words of each text, and what is found in it."""
        t = tokens_of(column, LETTERS)
        n = len(column)
        ends = np.flatnonzero(t.number < 0)
        starts = np.concatenate([[0], ends[:-1] + 1])[:n]
        numbers = np.array([self.number.get(w, -1) for w in t.distinct] + [-1])
        tok = np.where(t.number < 0, -1, numbers[t.number])
        some = np.flatnonzero(tok >= 0)
        # words of templates alone, with their places; texts lie so far apart that no block spans two
        tok, doc = tok[some], t.doc[some]
        gap = max(x.block for x in self.templates)
        place = some + gap * doc
        found: list[list[dict]] = [[] for _ in range(n)]
        for j in range(len(self.templates)):
            for at, length, share in self._blocks(j, tok, place):
                d = int(doc[at])
                found[d].append({"label": self.templates[j].label, "start": int(some[at] - starts[d]), "length": length, "share": share, "ordered": self.templates[j].ordered})
        return np.asarray(ends - starts, np.int64), found

    def _blocks(self, j: int, tok: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(index of its first word in tok, words, share) of each block; of those that overlap the best, then the first."""
        template, own = self.templates[j], self.own[j]
        rare = place[self.prefix[j][tok]]
        if not len(rare):
            return
        size, needed, total = template.block, template.needed, int(own.sum())
        hits = np.flatnonzero(own[tok])
        at = place[hits]
        # prefix: a block from here holds one of the rarest words
        following = np.searchsorted(rare, at)
        near = np.append(rare, np.iinfo(np.int64).max)[following] < at + size
        # length: it holds words enough
        stop = np.searchsorted(at, at + size)
        first = np.flatnonzero(near & (stop - np.arange(len(at)) >= needed))
        rank = np.cumsum(own) - 1  # of a word in the template's order
        best = None
        for i in first.tolist():
            words = tok[hits[i : stop[i]]]
            if total - int(rank[words].min()) < needed:  # position
                continue
            distinct = np.unique(words)
            if len(distinct) < needed or not np.isin(self.must[j], distinct).all():
                continue
            if template.never and self.never[j][tok[hits[i] : np.searchsorted(place, at[i] + size)]].any():
                continue
            share = len(distinct) / total
            if template.ordered:
                if len(words) == len(self.order[j]) and (words == self.order[j]).all():
                    yield int(hits[i]), len(words), share
                continue
            one = (int(hits[i]), int(at[stop[i] - 1] - at[i]) + 1, share, int(at[i]))
            if best is not None and one[3] < best[1]:
                best = (one if share > best[0][2] else best[0], one[3] + size)
            else:
                if best is not None:
                    yield best[0][:3]
                best = (one, one[3] + size)
        if best is not None:
            yield best[0][:3]


def find_licenses(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *LICENSES)) -> DataFrame:
    """docs with n_words and licenses: label, start (in words), length, share and kind of every block of each whole text that meets a template.

    Of blocks that meet one template and overlap in a chain the one with the largest share is given, of equal ones the first. A null or empty text has no words and no
    blocks. Rows and other columns stay as they are; columns named n_words or licenses give way.
    """
    words = sorted({w for t in templates for w in t.words})
    scanner = Scanner(templates, word_counts(docs, words))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n, found = scanner.scan(batch.column(batch.schema.get_field_index("text")))
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("share", pa.float64()), ("ordered", pa.bool_())]))
        return {"n_words": pa.array(n), "licenses": pa.array(found, kind)}

    return with_columns(docs, run, schema(n_words="long", licenses=FOUND))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document; score: the largest share of a template, 0 without one."""

    def labels(x: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda v: v["label"]))), ",")

    all_, base = F.col("licenses"), F.filter("licenses", lambda v: v["ordered"])
    at = F.transform(base, lambda v: v["start"])
    found = find_licenses(docs.select("doc_id", "text")).drop("text")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), labels(base).alias("base_labels"), labels(all_).alias("labels"), F.coalesce(F.array_max(F.transform(all_, lambda v: v["share"])), F.lit(0.0)).alias("score"))
