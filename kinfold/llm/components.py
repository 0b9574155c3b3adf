"""Connected components by alternating stars, in DataFrames; every round is staged durably."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: A node with more edges than this, and than the ``HEAVY_SHARE``-th part of all, is heavy. Heavy
#: nodes are fewer than twice ``HEAVY_SHARE``, so they go to the tasks in a broadcast.
HEAVY = 1000
HEAVY_SHARE = 5000
#: Up to so many edges are joined in one task: rounds would cost more than they spread.
FEW = 200_000


def _least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame | None]:
    """(light nodes (u, m), heavy nodes (hu, hm) or None): the least ``b`` of each ``a``, or ``a`` if it is less.

    Only minima and counts are aggregated.
    """
    low = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
    low = stage(low.withColumn("m", F.least("u", "m")), "cc-least")
    heavy = F.col("n") > max(HEAVY, total // HEAVY_SHARE)
    if low.where(heavy).isEmpty():
        return low.select("u", "m"), None
    return low.where(~heavy).select("u", "m"), low.where(heavy).select(F.col("u").alias("hu"), F.col("m").alias("hm"))


def _moved(edges: DataFrame, light: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """(a, b) = (b, least of a) of all edges. Edges of heavy nodes are not shuffled by them."""
    if heavy is None:
        return edges.join(light, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    e = edges.join(F.broadcast(heavy), F.col("a") == F.col("hu"), "left")
    rest = e.where("hm is null").select("a", "b").join(light, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return e.where("hm is not null").select(F.col("b").alias("a"), F.col("hm").alias("b")).unionByName(rest)


def matched(rows: DataFrame, key: str, found: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with ``found`` (key, n, ...) by ``key``, n being the rows of a key. Rows of heavy keys are not shuffled by them."""
    found = stage(found, "cc-found")
    heavy = F.col("n") > max(HEAVY, total // HEAVY_SHARE)
    light = rows.join(found.where(~heavy).drop("n"), key)
    if found.where(heavy).isEmpty():
        return light
    return rows.join(F.broadcast(found.where(heavy).drop("n")), key).unionByName(light)


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) to (node, component)."""
    t = [b for b in batches if b.num_rows]
    if not t:
        return
    t = pa.Table.from_batches(t)
    a, b = (t.column(n).to_numpy() for n in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(i):
        x, y = least[i], least[j]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != (up := least[least])).any():
            least = up
        apart = least[i] != least[j]
        i, j = i[apart], j[apart]
    kind = t.schema.field("a").type
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[least], kind)], ["node", "component"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); component is the least node. Loops and repeats are harmless.

    Large star: each node links its larger neighbours to its least neighbour. Small star: each
    node links its smaller neighbours and itself to the least. Both keep the components; when
    nothing changes, all edges point to the least node. Rounds grow as the logarithm of the
    longest path. No task gathers a node's neighbours, nor the edges of a heavy node. ``FEW``
    edges or less go to one task instead.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        if state[0] <= FEW:
            kind = e.schema["a"].dataType.simpleString()
            return stage(e.repartition(1).mapInArrow(_in_task, f"node {kind}, component {kind}"), "cc-few")
        before = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        light, heavy = _least(both, state[0])
        down = stage(_moved(both.where("b > a"), light, heavy).where("a > b").distinct(), "cc-large")
        light, heavy = _least(down, state[0])
        own = light if heavy is None else light.unionByName(heavy.select(F.col("hu").alias("u"), F.col("hm").alias("m")))
        small = _moved(down, light, heavy).unionByName(own.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = stage(small.where("a <> b").distinct(), "cc")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
