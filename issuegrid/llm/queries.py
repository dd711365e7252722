"""Registered queries of the subpackage: each operator over its whole table.

Every entry is ``fn(spark, sf_dir) -> DataFrame`` with production parameters;
``ORACLES`` holds DuckDB SQL where SQL can express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import alignment_digest
from .bpe import round_trip_digest
from .decontam import contamination_digest
from .divergence import source_divergence
from .egojoin import near_vectors
from .minhash import near_duplicates
from .oracles import ORACLES  # noqa: F401
from .packing import packed_rows
from .quality import quality_scores
from .sanitise import sanitised_digest
from .substrings import repeated_substrings_digest
from .tokencount import token_counts
from .toxicity import toxicity_scores
from .urlfilter import url_verdicts


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files lie (the same place on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the recurrent network."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and kept flag of every document (3-word shingles, 85 % of the union)."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram piece counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of 13-word benchmark windows."""
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the sparse rule ensemble."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier, as digests."""
    return repeated_substrings_digest(table(spark, sf_dir, "documents"))


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids packed into rows of 2048."""
    return packed_rows(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's BPE ids and of their decoded text."""
    return round_trip_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with cosine 0.95 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return url_verdicts(table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document, and how common its links are."""
    return alignment_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that the corpus shows to disclose it."""
    return sanitised_digest(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of a language's sources, and each source's most distinctive terms."""
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_token_packing": op8_token_packing,
    "op9_bpe_encoding": op9_bpe_encoding,
    "op10_url_filter": op10_url_filter,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_pii_sanitisation": op12_pii_sanitisation,
    "op13_source_divergence": op13_source_divergence,
}
