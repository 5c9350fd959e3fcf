"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

``STAGES`` are (name, function) with functions of (spark, docs, sf_dir); each stage's rows are
written and read again as the next one's. Part of the subpackage ``seqpick.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqpick.llm import decontam, mixing, quality, sharding, simhash
from seqpick.llm.common import stage_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the forest keep."""
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, forest).where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return simhash.keep_one(docs, simhash.near_groups(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark window."""
    return decontam.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole copies."""
    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot."""
    return sharding.deal(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: Forest, groups by similarity, apportionment and drawn matrix are beyond SQL; tests/llm holds each stage's operator against brute force, and the chain's counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
