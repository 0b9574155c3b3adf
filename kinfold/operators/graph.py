"""Connected components of an edge table, by alternating stars; each round is written to shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = shared_dir.own = tempfile.mkdtemp(prefix="kinfold-")
    return at.rstrip("/")


def durable(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every row of ``nodes`` (node); component is the least node reached over ``edges`` (a, b)."""
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        wide = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        narrow = wide.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = durable(narrow.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
