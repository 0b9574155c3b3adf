"""Proportional stratified interleaving of sources into shards; law ``rows``.

Each row gets a seeded pseudorandom rank within its source; (rank + phase) / source size
orders all rows; cutting that order into equal runs gives every shard the mixture of the
whole, and counts that differ by one at most.

A hot source is never ranked in one task: rows go to buckets by the leading part of their
hash, are ranked inside a bucket, and the buckets' counts (a small table) give the start.
The final order is cut the same way, by buckets of the fractional rank. The hash takes id,
text and size, so rows that share an id do not share a bucket; only wholly equal rows do.

Defined results: null sources are a source of their own; null texts have size 8; ties in
the hash go by doc_id and then by text; equal rows are interchangeable. An empty table
gives an empty result. Extra columns are ignored by ``assign()`` and kept by ``sharded()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_total, table

ROWS_PER_BUCKET = 1_000


def assign(rows: DataFrame, source: Column, order: list[Column], n_shards: int = 24, seed: int = 7) -> DataFrame:
    """``rows`` and ``shard``, ``slot``. ``order`` is hashed with the seed, and breaks the hash's ties."""
    n = rows.count()
    if n == 0:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    buckets = max(1, n // ROWS_PER_BUCKET)
    span = (1 << 32) // buckets + 1
    spread = F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(1 << 32))
    r = rows.withColumns({"_src": F.coalesce(F.concat(F.lit("s"), source), F.lit("")), "_h": spread, "_one": F.lit(1).cast("long")})
    r = running_total(r, ["_src"], [F.col("_h"), *order], F.floor(F.col("_h") / span), buckets, "_one", "_rank")
    totals = r.groupBy("_src").agg(F.count("*").alias("_of"))
    # a phase per source keeps small sources from all falling into the same places
    phase = F.pmod(F.xxhash64("_src", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    r = r.join(totals, "_src").withColumn("_frac", (F.col("_rank") + phase) / F.col("_of"))
    place = [F.col("_frac"), F.col("_src"), F.col("_rank")]
    r = running_total(r, [], place, F.least(F.floor(F.col("_frac") * buckets), F.lit(buckets - 1)), buckets, "_one", "_pos")
    # shard s holds the places from ceil(s n / k) on, so counts differ by one at most
    shard = F.expr(f"cast((_pos * {n_shards}L) div {n}L as int)")
    r = r.withColumn("shard", shard)
    first = F.expr(f"(cast(shard as bigint) * {n}L + {n_shards - 1}L) div {n_shards}L")
    return r.withColumn("slot", F.col("_pos") - first).drop("_src", "_h", "_one", "_rank", "_of", "_frac", "_pos")


def digest(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    slim = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    r = assign(slim, F.col("source"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], n_shards)
    return r.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def sharded(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """``docs`` with two more columns, ``shard`` and ``slot`` (replacing columns of these names)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), F.col("source").alias("_source"))
    return assign(packed, F.col("_source"), [F.col("_id"), F.col("_th")], n_shards).select("_row.*", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
