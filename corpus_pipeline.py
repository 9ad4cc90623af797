"""The corpus pipeline: quality, near copies, benchmark leaks, personal data, pieces; each stage takes what the one before kept.

Every stage looks at all rows it is given and keeps all columns; the last gives doc_id, n_pieces and ids. Defined cases: a null text
counts as empty, is scored like one, resembles and leaks nothing, and stays null until the last stage, which gives it no pieces;
rows with a null doc_id are never removed as copies; a repeated row stays once, other texts under one doc_id stay apart;
among near copies the least doc_id stays (by doc_id and text, where ids tie); very long texts are read whole; empty tables give empty
results; extra columns, whatever their names, pass through. Without labels no text is rejected for its quality (all score 0.5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hitweave.llm import decontaminate, jaccard, pieces, pii, quality
from hitweave.llm.common import shared_path, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    return jaccard.keep_first(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every document."""
    return pieces.encode(docs)


STAGES = [
    ("quality", keep_good_quality),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("pieces", encode_pieces),
]

#: The classifier, the pruned join and the fields can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again as the next stage's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
