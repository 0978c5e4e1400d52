"""A corpus pipeline: documents without toxic ones, unknown languages, near copies and benchmark passages, packed for training.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces. Null texts and ids, empty tables,
repeated rows, texts of any length and further columns of any name pass through every stage; what a stage drops is said there. No SQL can express the
stages; tests/llm/test_pipeline.py holds them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontamination, langid, near_copies, packing, toxicity
from quantloom.llm.common import dropped, named, table, written
from quantloom.llm.queries import tokenizer_path

#: A document whose language is known with less than this score goes; a document without letters goes as well.
LEAST_LANGUAGE_SCORE = 0.2


#: Distinct pieces that a worker remembers in packing: few, as the stages before have filled the executors' memory.
MOST_PIECES = 300_000


def kept(docs: DataFrame, mark, condition: str) -> DataFrame:
    """Rows that a marking operator leaves, with their own columns: others than doc_id and text are put aside while it adds its own."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    aside = docs.select("doc_id", "text", F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("__rest")) if rest else docs
    return mark(aside).where(condition).select(*[F.col(f"__rest.c{rest.index(c)}").alias(c) if c in rest else named(c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained on labels outside its held-out fold) doesn't call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return kept(docs, lambda d: toxicity.detect(d, model), "predicted = 0")


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus names."""
    model = langid.train(docs)
    return kept(docs, lambda d: langid.identify(d, model), f"lang_pred != 'und' AND score >= {LEAST_LANGUAGE_SCORE}")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingle sets are alike to 0.8 or more: the least doc_id, null ids last.

    Fingerprints joined by Golay-code keys bring most copies together; the pairs that these can't reach come by a prefix filter.
    """
    return near_copies.one_of_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 2048 tokens."""
    return packing.pack_texts(docs, tokenizer_path("byte_bpe_50k.json"), most_pieces=MOST_PIECES)


STAGES = [
    ("toxicity", without_toxic),
    ("language", of_known_language),
    ("near_copies", one_of_near_copies),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents. Each stage's result is written before the next one reads it, so no stage runs twice."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        dropped(before)  # never the table of documents, which lies elsewhere
    return docs
