"""Cleaning and mixing a corpus: five stages over the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept; what it returns is written as Parquet and read again for the next one.
All stages but the last return the columns of ``docs``, and all of them keep
clean documents.  Null texts, null ids, repeated rows, empty tables and other
columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsight.llm import decontaminate, mixing, quality, secrets, simhash
from tabsight.llm.common import read_table
from tabsight.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or read unlike the trusted ones go."""
    return quality.drop_rejected(docs, read_table(spark, sf_dir, "labels").filter("quality = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 3 bits) stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; every document stays."""
    return secrets.mask(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates and copies of every document, for the target domain weights."""
    return mixing.mix(docs, read_table(spark, sf_dir, "labels"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scan", secret_scan),
    ("target_weights", target_weights),
]

#: Stages hash with XXH64 and fit models, which DuckDB cannot express; the
#: pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
