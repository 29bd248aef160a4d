"""A training-corpus pipeline: quality, near-duplicates, decontamination, secrets, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openings.llm.cotraining import keep_good, train_quality
from openings.llm.decontaminate import decontaminate
from openings.llm.durable import durable
from openings.llm.minhash import keep_one
from openings.llm.mixing import mixed_blocks
from openings.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; it learns from the labels of the documents at hand."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the smallest id) of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, k=5, threshold_percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked (widely copied examples stay) and n_chars counted again."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row a slot of an output shard (shard, slot, source, epoch, block, words, doc_ids, text)."""
    return mixed_blocks(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: Classifier, signatures and permutations are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on all that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
