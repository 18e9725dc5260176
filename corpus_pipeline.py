"""The corpus pipeline: quality rules, near-dedup, decontamination, redaction, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of docs, with fewer rows or redacted texts; the last adds the token ids and checks that
they decode to the text.

Nulls, blank and long texts, ties, repeated rows, empty tables and columns beyond those of
documents are handled as each operator says: a null or blank text goes with the quality rules;
repeated rows are near-duplicates of each other; further columns, whatever their names, pass all
stages but the last, which returns those of its own; empty tables stay empty.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import bpe, decontaminate, near_dedup, pii, quality
from gridspark.llm.common import shared_folder, table
from gridspark.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, a similarity of 0.8)."""
    return near_dedup.deduplicated(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets."""
    return pii.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, n_tokens, ids and whether the ids decode to the text."""
    return bpe.round_trip(docs, *vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("PII", redaction),
    ("byte-level BPE", token_ids),
]

#: The trees of the redaction stage and MinHash have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
