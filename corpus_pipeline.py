"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and encoding, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as a table in the shared folder and
gives it to the next. All but the last return the columns of documents.

Cases: a null or empty text has no words, so the quality rules drop it, and the later stages see none from run() (by
themselves they keep such rows: as classes of their own, without secrets, of size 0 and so not in the mix, without ids);
texts of any length are read whole; equal rows are one after near_dedup; a null doc_id sorts first and a null source is
a source of its own; an empty table gives no rows; extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from earshot.llm import bpe, minhash, mixing, quality, secrets
from earshot.llm.common import cut, discard, gathered, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality policy rejects."""
    return quality.keep(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one of the smallest doc_id."""
    return minhash.distinct_docs(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts."""
    return secrets.masked_docs(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their target weights."""
    return mixing.mixed_docs(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids and their number."""
    return bpe.encoded_docs(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: Signatures, randomness tests and merges have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for itself is deleted as soon as its rows are a table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with gathered() as made:
            docs = cut(stage(spark, docs, sf_dir), name)
        discard(before, *[t for t in made if t is not docs])
    return STAGES[-1][1](spark, docs, sf_dir)
