"""From documents to shards in five stages, each of the operators in perievent.llm.

Every stage takes what the one before kept. The first four return the columns of documents, the last adds size, shard
and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perievent.llm import base, decontaminate, mixing, quality, sharding, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; short ones that are clean otherwise stay."""
    return quality.keep(docs, quality.FILTER)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id."""
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, base.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot; rows of equal texts share a shard."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix_sources),
    ("sharding", deal_shards),
]

#: Fingerprints, seeds, the knapsack and the differencing are not SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again before the next."""
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = base.stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
