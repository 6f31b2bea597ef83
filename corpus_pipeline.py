"""Document cleaning pipeline: low quality, exact copies, near copies and benchmark leaks go; what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and but for the last
returns the columns of documents. Stages are written as Parquet below spark.checkpoint.dir and read again.

Null and empty texts are documents like others: the classifier scores them, equal ones are exact copies of
each other. Rows that repeat doc_id and text are exact copies. An empty table passes through.
Other columns of documents, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retrofit_spark.llm import bpe, keeping, quality
from retrofit_spark.llm.scratch import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keeping.without_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keeping.without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keeping.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: The classifier can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
