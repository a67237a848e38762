"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vesperine.llm import decontaminate, exact_dedup, langid, minhash, mixing
from vesperine.llm.common import drop_shared, kept


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told: letterless ones, and those
    in no language that was learnt (code, gibberish, other scripts)."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, similarity 0.8, one stays."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("decontamination", benchmark),
    ("mixing", mixture),
]

# SQL cannot express language ID and alignment; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        docs = kept(spark, lambda: stage(spark, before, sf_dir), f"stage-{name}")  # noqa: B023  called at once
        if k:
            drop_shared(before)
    return STAGES[-1][1](spark, docs, sf_dir)
