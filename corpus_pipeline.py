"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

The quality ranker rejects documents, of each group of near-duplicates one stays, documents that hold part
of a benchmark item go, the sources are mixed to their target weights, and what is left becomes token ids.

Any columns of documents pass through all stages but the last. Null and empty texts go with the first stage where its
ranker rejects empty texts; empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import op1_mixing, op3_near_dups, op5_token_ids, op6_quality, op10_decontamination
from tidemark.llm.common import documents, remove, run_dir

#: Training of the first stage isn't SQL's work.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_near_dups.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontamination.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_token_ids.written_and_read(docs)


STAGES = [
    ("quality", quality),
    ("near_dups", near_dups),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents. A stage's table goes once the next one has been written."""
    docs, before = documents(spark, sf_dir), None
    at = f"{run_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{name}")
        if before:
            remove(spark, f"{at}/{before}")
        before = name
    return docs
