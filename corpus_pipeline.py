"""A corpus-cleaning pipeline over ``documents``; each stage's rows are the next one's input.

Every stage but the last returns the columns of ``documents``. In order: documents that the toxicity model rejects
go; one document of each group of near copies stays; documents that hold a benchmark passage go; secrets are replaced
by a mark; what is left is packed into batches of equal padded length.

Nulls, empty texts, ties and repeated rows have the results that the operators' modules state; columns besides those
of ``documents`` pass through the filtering stages unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import decontam, packing, queries, secret_scan, similarity, toxicity
from tracelake.runtime import Scratch, table

#: Shingle size and least similarity of near copies.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more by the model trained on ``labels`` go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, found by SimHash and compared exactly, the document with the smallest id stays."""
    return similarity.keep_one_similar(docs, NEAR_WORDS, NEAR_SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found by pattern or by guess cost are replaced by a mark; every document stays."""
    return secret_scan.redact_documents(docs, ranks=queries.known_words())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its length bucket, batch and slot."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No SQL: toxicity scores come from a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage but the last is written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
