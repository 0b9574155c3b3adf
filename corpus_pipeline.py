"""The corpus pipeline: STAGES in order, each working on all its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables
and further columns of any names, which it keeps; each says what it makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontam, jaccard, mixing, quality, shards
from kinfold.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; repeated rows are judged each."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The least id stays, a null id after all others, of equal ids the least text hash, of equal
    rows one. Documents without words all stay.
    """
    return jaccard.kept(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts and items match nothing; repeated rows go or stay alike."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws the block with their first word, three times at most.

    Null sources are one source. Documents without words go. Each of several equal rows has its
    own place in its source's stream.
    """
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot, which replace columns of these names. Null sources are one source; all rows stay."""
    return shards.sharded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: No SQL: signatures, BM25 windows, keyed permutations and seeded ranks have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
