"""The corpus pipeline: toxicity, quality rules, near duplicates, benchmark decontamination, packing.

Each stage works on all rows that its predecessor kept, written as Parquet in the shared folder and
read again. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinworks.llm import decontam, line_labels, packing, simhash, toxicity
from skeinworks.llm.rows import small_batches
from skeinworks.plans.stash import stash


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network doesn't reject."""
    small_batches(spark)
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the labelled lines' content share keep."""
    small_batches(spark)
    return line_labels.keep(docs, line_labels.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    small_batches(spark)
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontam.unleaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of 2,048 tokens."""
    small_batches(spark)
    return packing.packed_documents(docs)


STAGES = [("toxicity", without_toxic), ("quality", of_quality), ("near_duplicates", without_copies), ("decontamination", without_benchmark), ("packing", packed)]

#: SQL can't express a trained network, so the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
