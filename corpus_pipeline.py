"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents, so a lost executor
costs a re-read.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadworthy.llm import decontamination, mixing, quality, sharding, simhash
from roadworthy.llm.common import table, written
from roadworthy.llm.queries import MIX_SEED, QUALITY_LEAST, SHARDS, SIMHASH_BITS, SIMHASH_SHINGLE, fold

#: Share of the remaining tokens that the mixture takes; no document is taken twice.
MIX_SHARE = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    net = quality.learn(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return quality.keep(docs, net, QUALITY_LEAST)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_of_each(docs, SIMHASH_SHINGLE, SIMHASH_BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the mixture of domains, languages and sources."""
    return mixing.mix(docs, MIX_SHARE, max_epochs=1, seed=MIX_SEED)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return sharding.assign(docs, ["doc_id"], [1.0] * SHARDS, next_weight=None, ties=["text"]).drop("grown_shard")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL: the first stage is a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
