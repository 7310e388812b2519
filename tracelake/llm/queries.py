"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import arc_warc, decontam, media_chunks, packing, quality, secret_scan, simhash, substring_dedup, token_count, toxicity
from tracelake.runtime import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def known_words() -> dict[str, int]:
    """The words that make a secret cheap to guess: an English vocabulary's and one for many languages'."""
    return secret_scan.ranked_words(*map(vocabulary_path, ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.shown(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), limit=1024)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents"), ranks=known_words()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.round_trip(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_arc_to_warc": op7_arc_to_warc,
    "op8_media_chunks": op8_media_chunks,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
}
