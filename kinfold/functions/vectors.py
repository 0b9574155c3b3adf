"""Vector expressions over array columns. Norms are bound once, not re-evaluated per element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """v / |v|; a zero vector stays."""
    return bind(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def normalise_eps(v: Column, eps: float = 1e-8) -> Column:
    """v / (|v| + eps)."""
    return bind(norm(v) + F.lit(eps), lambda n: F.transform(v, lambda x: x / n))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def above(sim: Column, limit: float) -> Column:
    """sim > limit, where NaN is not above anything (Spark alone orders NaN above all)."""
    return ~F.isnan(sim) & (sim > F.lit(limit))


def below(sim: Column, limit: float) -> Column:
    return ~F.isnan(sim) & (sim < F.lit(limit))


#: Rows of one key that one median buffer may hold; the values of larger keys are narrowed down first.
MEDIAN_ROWS = 1_000_000
#: Steps that the values of a key and position are cut into, each time they are narrowed down.
MEDIAN_CELLS = 1024


def _middle(each: DataFrame, key: str) -> DataFrame:
    """Rows (key, _p, _x) to (key, _p, _m): the exact median, from counts by value in ever smaller cells.

    Two counts by cells leave about a millionth of the distinct values; these are counted one by
    one. No task holds all values of a key and position.
    """
    from pyspark.sql import Window

    by = [key, "_p"]
    counted = each.groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    # the ranks (from 0) of the one or two middle values
    n = each.groupBy(*by).agg(F.count("*").alias("_n"))
    want = n.select(*by, F.floor((F.col("_n") - 1) / 2).alias("_r1"), F.floor(F.col("_n") / 2).alias("_r2"), F.lit(0).cast("long").alias("_before"))
    running = F.sum("_c").over(Window.partitionBy(*by).orderBy("_k"))
    for _ in range(2):
        ends = counted.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        cell = F.least(F.floor(F.coalesce(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * MEDIAN_CELLS), F.lit(MEDIAN_CELLS - 1))
        celled = counted.join(ends, by).withColumn("_k", cell)
        cells = celled.groupBy(*by, "_k").agg(F.sum("_c").alias("_c")).withColumn("_to", running).withColumn("_from", F.col("_to") - F.col("_c"))
        cells = cells.join(want, by)
        hit = cells.where("_from + _before <= _r2 and _to + _before > _r1")
        start = hit.groupBy(*by).agg(F.min(F.col("_from") + F.col("_before")).alias("_b2"))
        want = want.join(start, by).select(*by, "_r1", "_r2", F.col("_b2").alias("_before"))
        counted = celled.join(hit.select(*by, "_k"), [*by, "_k"]).select(*by, "_x", "_c")
    at = counted.withColumn("_to", F.sum("_c").over(Window.partitionBy(*by).orderBy("_x"))).join(want, by).withColumn("_to", F.col("_to") + F.col("_before"))
    lo = F.min(F.when(F.col("_to") > F.col("_r1"), F.col("_x")))
    hi = F.min(F.when(F.col("_to") > F.col("_r2"), F.col("_x")))
    return at.groupBy(*by).agg(((lo + hi) / 2).alias("_m"))


def median_vector(rows: DataFrame, key: str, vec: str, into: str) -> DataFrame:
    """Elementwise exact median of ``vec`` by ``key``: of up to ``MEDIAN_ROWS`` rows a key by buffers, else by counts."""
    each = rows.select(key, F.posexplode(vec).alias("_p", "_x"))
    most = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    med = each.groupBy(key, "_p").agg(F.median("_x").alias("_m")) if most <= MEDIAN_ROWS else _middle(each, key)
    return med.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(into))


def mean_vector(rows: DataFrame, key: str, vec: str, into: str) -> DataFrame:
    each = rows.select(key, F.posexplode(vec).alias("_p", "_x"))
    mean = each.groupBy(key, "_p").agg(F.avg("_x").alias("_m"))
    return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(into))
