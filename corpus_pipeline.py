"""A corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontam, minhash, mixing, quality, sharding
from strandlake.llm.common import Workspace, table
from strandlake.llm.queries import labelled_domains


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the languages' tokens meet the target weights; targets leave no language below what it has."""
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the compacted store's committed version returns them."""
    return sharding.shard(docs)[1]


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]
#: The first and fourth stage fit models; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
