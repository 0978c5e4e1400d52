"""The queries of this subpackage, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .clusters import cluster_embeddings
from .common import table
from .decontamination import leaks
from .langid import identify_documents
from .licenses import scan_documents
from .lm_scores import score_documents
from .packing import pack_conversations, pack_texts
from .quality import rate_documents
from .sharding import histogram_sort
from .simhash import near_duplicates
from .sketches import fingerprint_edits
from .spellings import spelling_variants
from .token_counts import count_tokens
from .toxicity import detect_documents


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_embeddings(table(spark, sf_dir, "embeddings"))


def op12_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 on instruction data, where tokens, segments and loss are three limits."""
    return pack_conversations(table(spark, sf_dir, "conversations"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_convolutional_toxicity": op2_convolutional_toxicity,
        "op3_context_mixing": op3_context_mixing,
        "op4_naive_bayes_svm": op4_naive_bayes_svm,
        "op5_bottom_k_sketch": op5_bottom_k_sketch,
        "op6_histogram_sort": op6_histogram_sort,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_string_kernel_language": op8_string_kernel_language,
        "op9_benchmark_leaks": op9_benchmark_leaks,
        "op10_vector_packing": op10_vector_packing,
        "op11_delta_lloyd": op11_delta_lloyd,
        "op12_errata_trie": op12_errata_trie,
        "op13_license_scan": op13_license_scan,
        "conversation_packing": conversation_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_delta_lloyd": oracles.cluster_embeddings(), "op12_errata_trie": oracles.spelling_variants(), "op13_license_scan": oracles.license_scan()}
