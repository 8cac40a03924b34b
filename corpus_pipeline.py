"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import decontam, mixing, neardup, quality, sharding
from labelforge.llm.common import saved
from labelforge.session import table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score under 0.3). Null texts are scored as empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, likeness of 0.8 or more).

    The least id of a group stays. Texts without words and null ids stay; of rows that repeat an id one stays.
    """
    return neardup.keep_one(docs, 80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates: under a twentieth of their words lies in its windows. Null texts stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands as often as the mix takes it, so texts without words go."""
    return mixing.emit(mixing.mix(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes, with slots; equal texts (null as empty) lie together. An empty table has none."""
    return sharding.shard_documents(docs, 8)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("sharding", sharded)]
#: Boosted trees and hashed draws are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
