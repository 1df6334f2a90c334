"""A training-data pipeline: each stage works on all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return rows; all but the last return the
columns of ``documents``. What one stage returns is written as Parquet and read
again as the next one's ``docs``.

Null and empty texts have no words, so the rules reject them; nulls in other
columns change nothing, and a null source is a host of its own. Rows that repeat
a doc_id are documents of their own; of rows that tie as near-duplicates one
stays. Very long texts pass whole, further columns pass as they are, and an
empty table, of documents or of benchmark items, passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontaminate, near_dedup, quality_rules, secret_scan
from quillon.llm.common import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, on five-word shingles and a similarity of 0.8."""
    return near_dedup.keep_documents(docs, near_dedup.STAGE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.keep_documents(docs, documents(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secret_scan.redact_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    return bpe.encode_rows(docs, bpe.vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("byte_bpe", encoding),
]

#: Near-duplicates by MinHash, latent retrieval and BPE aren't expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
