"""A training corpus in five stages, each over all that the one before it kept.

Nulls, empty and very long texts, ties, repeated rows, empty tables and columns of any name give in each stage what the
operator that it calls says of them; no stage adds a rule of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlspike.llm import decontam, mixing, quality, sharding, simhash
from marlspike.llm.common import keep, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages that are short of their target repeat documents; none is dropped."""
    return mixing.mixed(docs, mixing.clean_languages(docs, table(spark, sf_dir, "labels")), mixing.TARGETS, at_least=1.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets one of eight shards and a slot in it."""
    return sharding.sharded(docs)


STAGES = [("quality", good), ("near-dedup", unique), ("decontamination", clean), ("mixing", mix), ("sharding", shard)]
#: Trained classifiers, LSH and label propagation are not SQL; tests hold near-dedup and decontamination against brute force,
#: the rates of quality and mixing against numpy, and sharding against its law.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
