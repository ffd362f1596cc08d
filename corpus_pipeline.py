"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Every stage works on all that the stage before kept, and its decisions take effect.  Nulls, empty tables and extra columns are
handled as the operators' docstrings say; a null ``doc_id`` passes through unless its row is rejected on its own account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleave.llm import decontaminate, jaccard_join, quality, repeats, sentencepiece_codec
from cleave.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occurred earlier leave the texts."""
    return repeats.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with questions of the benchmark go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Not expressible in SQL (fitted scores, merge-order encoding); tests/llm compares the stages, one after the other, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
