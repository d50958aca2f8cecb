"""A training corpus from ``documents``: toxic texts go, near copies go, contaminated texts go, sources are mixed, rows are sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontamination, mixing, sharding, simhash, toxicity
from foliant.llm.common import Scratch, table

#: Why there is no SQL: a trained network and a 64-bit hash vote decide what stays.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects as toxic go.

    Null and empty texts are judged as padding, repeated rows alike; an empty table stays empty. The network learns from
    the documents it is given. Columns stay as they are, whatever their names.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the smallest id, a null id below all.

    Texts without words are copies of each other; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark share of a twentieth or more go; null and empty texts stay, as do all columns."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh the same; a document is repeated or left out by its Poisson count.

    Rows without a source are a source; a source without any bytes goes. Columns that share a name with what mixing adds
    are dropped.
    """
    return mixing.mix(docs).select(*[c for c in docs.columns if c not in mixing.ADDED])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot, equal texts together as far as sizes allow."""
    return sharding.place(docs)


STAGES = [("toxicity", clean), ("simhash near-dedup", near_copies), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
