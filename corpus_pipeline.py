"""The corpus pipeline: quality rules, near-duplicates, decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. Every stage takes nulls in any column, empty texts, repeated rows, empty tables and further columns; all but
the last keep the columns as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cueweave.llm import decontam, jaccard, mixing, pii, quality
from cueweave.llm.common import removed, shared_folder, table
from cueweave.llm.queries import pii_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees' verdict go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are similar by 0.8 or more, the one with the smallest id stays.

    SimHash compares what shares a rare shingle, whole sets confirm it; copies go by chains of such pairs.
    """
    return jaccard.keep_one(docs, shingle=5, least=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid private values are replaced by pseudonyms."""
    return pii.pseudonymise(docs, pii_key(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its slot and place in the mixture of sources."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", private_values),
    ("mixing sources", mixture),
]

#: SQL can't express the trees, fingerprints and alignments; tests compare run() with the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; earlier stages' files are removed once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
