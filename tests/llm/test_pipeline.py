"""The corpus pipeline, stage by stage against brute force."""

import collections
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp

from test_near_copies import brute

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "near_copies", "benchmark", "packing"]

    kept = cp.STAGES[0][1](spark, docs, DATA)
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    toxic, clean = ({i for i, r in labels.items() if r.toxic == v} for v in (1, 0))
    assert len(ids & toxic) / len(toxic) < 0.1 and len(ids & clean) / len(clean) > 0.95

    kept = cp.STAGES[1][1](spark, kept, DATA).cache()
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == ids  # all have letters of a known language

    # one document of each component of five-word likeness
    want = brute(sorted((r.doc_id, r.text) for r in kept.collect()))
    kept = cp.STAGES[2][1](spark, kept, DATA).cache()
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    exact = {d for d in want if any(f" {plain(r.text)} " in f" {plain(before[d].text)} " for r in bench)}
    kept = cp.STAGES[3][1](spark, kept, DATA).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and exact and ids <= want - exact
    assert len(want - exact - ids) <= 2

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = collections.Counter()
    for r in cp.STAGES[4][1](spark, kept, DATA).collect():
        packed[r.doc_id] += r.length
    assert packed == {d: len(library.encode(before[d].text, add_special_tokens=False).ids) + 1 for d in ids}


def test_stages_keep_rows_with_nulls_and_extra_columns(spark):
    rows = [(1, None, None, "s", 0, 0.1), (2, "plain text with some words in it", "en", None, None, 0.2), (None, "another plain text of words", "en", "s", 1, None), (3, "yet another text with other words", "en", "s", 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert {r.score for r in out.where(F.col("doc_id") == 3).collect()} == {0.5}, name
    assert cp.STAGES[1][1](spark, docs, "/root/testdata/sf0.001").where("doc_id = 1").count() == 0


SMALL = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, __nth int, __leak int, __row int, __rest int, score double, predicted int, `a.b` int, `x y``z` string"


def row(i, text, lang="en"):
    return (i, text, lang, "s", None, 1, 2, 3, 4, 0.5, 6, 7, "v")


def test_stages_take_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], KINDS)
    for name, stage in cp.STAGES:
        out = stage(spark, none, SMALL)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns), name
    some = spark.createDataFrame([row(i, f"some words of text {i} and words that no other text of these has so far") for i in range(6)], KINDS)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, some, SMALL).collect()
        assert len(out) == 6 and all(tuple(r)[5:] == (1, 2, 3, 4, 0.5, 6, 7, "v") for r in out), name


def test_stages_keep_repeated_rows_and_long_texts(spark):
    long = " ".join(f"word{i % 5000} and" for i in range(60_000))
    docs = spark.createDataFrame([row(1, long), row(2, "one short text of a few words"), row(2, "one short text of a few words"), row(2, "another text that has the same number"), row(None, long + " end")], KINDS)
    for name, stage in cp.STAGES[:2] + cp.STAGES[3:4]:
        assert stage(spark, docs, SMALL).count() == 5, name
    kept = cp.STAGES[2][1](spark, docs, SMALL).collect()  # copies go, whatever ids they share
    assert sorted((r.doc_id, r.text[:7]) for r in kept) == [(1, "word0 a"), (2, "another"), (2, "one sho")]
    assert sum(r.length for r in cp.STAGES[4][1](spark, docs, SMALL).collect()) > 200_000


def test_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toArrow())
    want = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect())
    got = cp.run(spark, SMALL)
    assert {r.doc_id for r in got.collect()} == {w[0] for w in want} and sum(w[2] for w in want) == got.agg(F.sum("length")).first()[0]
