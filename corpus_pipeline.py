"""A training corpus in five stages: quality rules, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents; the last adds slot and shard.  Null
and empty texts are rejected by the first stage; repeated rows are near-duplicates; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import materialize
from lectern.llm.decontaminate import decontaminate
from lectern.llm.mixing import take_mixture
from lectern.llm.ngram_join import keep_one
from lectern.llm.quality import keep_good
from lectern.llm.queries import PIPELINE_SQL
from lectern.llm.shards import assign_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights leave room for stay, each at most once."""
    return take_mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its slot and shard."""
    return assign_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: SQL of run()'s rows: that of the five operators, each over what the stage before it kept.
ORACLE_SQL = PIPELINE_SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
