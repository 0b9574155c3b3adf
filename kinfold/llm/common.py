"""Shared helpers: reading tables, the word rule, staged tables, surviving lost executors.

Every staged table is Parquet in the folder that the cluster names in
``spark.checkpoint.dir``; nothing is kept only in executors' memory or local disks.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of the contracts, and its complement.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset and all runs on this machine (tests), a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = shared_dir.own = tempfile.mkdtemp(prefix="kinfold-")
    return at.rstrip("/")


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of plans that are done: it does so when their handles are collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def words_of(text: Column) -> Column:
    """All words of a text in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bucket sums that one task may add up; more are added up by buckets of buckets.
BUCKETS_PER_TASK = 4096


def _starts(sums: DataFrame, group: list[str], n_buckets: int) -> DataFrame:
    """Rows (group, _kb, _ks) to (group, _kb, _k0): the sum of ``_ks`` over all earlier buckets of the group."""
    from pyspark.sql import Window

    zero = F.lit(0).cast("long")
    before = lambda *by: Window.partitionBy(*(by or [F.lit(0)])).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    if n_buckets <= BUCKETS_PER_TASK:
        return sums.select(*group, "_kb", F.coalesce(F.sum("_ks").over(before(*group)), zero).alias("_k0"))
    wide = sums.withColumn("_ku", F.floor(F.col("_kb") / BUCKETS_PER_TASK))
    inner = wide.withColumn("_ki", F.coalesce(F.sum("_ks").over(before(*group, "_ku")), zero))
    above = wide.groupBy(*group, F.col("_ku").alias("_kb")).agg(F.sum("_ks").alias("_ks"))
    above = _starts(above, group, -(-n_buckets // BUCKETS_PER_TASK)).withColumnsRenamed({"_kb": "_ku", "_k0": "_kv"})
    return inner.join(above, [*group, "_ku"]).select(*group, "_kb", (F.col("_ki") + F.col("_kv")).alias("_k0"))


def running_total(df: DataFrame, group: list[str], order: list[Column], bucket: Column, n_buckets: int, value: str, into: str) -> DataFrame:
    """``into`` = the sum of ``value`` over all earlier rows of ``group``, in two or more levels.

    ``bucket`` (0 .. ``n_buckets`` - 1) must be nondecreasing along ``order`` within a group, so
    that a hot group is spread over many buckets: rows are summed in their bucket, and the
    buckets' own sums (a small table, itself added up by buckets) give each bucket's start. No
    task ever holds a whole group.
    """
    from pyspark.sql import Window

    b = df.withColumn("_kb", bucket)
    inner = Window.partitionBy(*group, "_kb").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_kin", F.coalesce(F.sum(value).over(inner), F.lit(0).cast("long")))
    sums = b.groupBy(*group, "_kb").agg(F.sum(value).alias("_ks"))
    return b.join(_starts(sums, group, n_buckets), [*group, "_kb"]).withColumn(into, F.col("_k0") + F.col("_kin")).drop("_kb", "_kin", "_k0")
