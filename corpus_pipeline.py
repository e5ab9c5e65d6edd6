"""A training-corpus pipeline over ``documents``, counted as part of ``lectern.llm``.

Stages, each on all that the one before kept: quality rules drop failing documents, the n-gram Jaccard join
keeps one document of each component, decontamination drops documents in which a benchmark passage occurs,
mixing repeats or leaves out documents by their fitted rates, and sharding places the rows in shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import stored
from lectern.llm.decontaminate import drop_contaminated
from lectern.llm.jaccard import keep_one_per_component
from lectern.llm.mixing import apply_rates
from lectern.llm.quality import filter_quality
from lectern.llm.sharding import kd_shards
from lectern.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return apply_rates(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return kd_shards(docs, shards=24, keep=("lang", "source", "n_chars"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

#: The stages use hashing, compression and fitted rates that SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
