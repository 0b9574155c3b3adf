"""Pairs of two vector sets, block by block: matrix products in Arrow batches, no collected side.

A set of n rows is cut into ceil(n / ROWS) blocks by a hash of its id; each pair of blocks is
one task's work, so a row is sent once per block of the other side and memory is bounded by
two blocks, whatever n is. Only what the body returns leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import durable

ROWS = 2048
#: So many times ROWS are a block where pairs of blocks leave few rows; products are then cut to TILE rows.
WIDE, TILE = 4, 512


def matrix(table: pa.Table, column: str) -> np.ndarray:
    rows = table.column(column).to_pylist()
    return np.array(rows, np.float64) if rows else np.zeros((0, 1))


def flat_matrix(table: pa.Table, column: str) -> np.ndarray:
    """The same without Python numbers; vectors must be there and of one length."""
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a, b, and for each the least node it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(i):
        x, y = least[i], least[j]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != (up := least[least])).any():
            least = up
        open_ = least[i] != least[j]
        i, j = i[open_], j[open_]
    return nodes, nodes[least]


def fresh(rows: DataFrame) -> DataFrame:
    """The same columns as new attributes, so that two derivations of one table can meet in a cogroup."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def n_blocks(rows: DataFrame, per_block: int | None = None) -> int:
    return max(1, -(-rows.count() // (per_block or ROWS)))


def self_blocks(rows: DataFrame, key: str, body: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, per_block: int | None = None) -> DataFrame:
    """``body(left, right, same)`` for each unordered pair of blocks; same: both are the same block."""
    n = n_blocks(rows, per_block)
    cut = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    dealt = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"_lo": F.least("_b", "_o"), "_hi": F.greatest("_b", "_o")}).drop("_o")

    def run(t: pa.Table) -> pa.Table:
        b = t.column("_b").to_numpy()
        lo, hi = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py()
        clean = t.drop_columns(["_b", "_lo", "_hi"])
        return body(clean.filter(pa.array(b == lo)), clean.filter(pa.array(b == hi)), lo == hi)

    return dealt.groupBy("_lo", "_hi").applyInArrow(run, schema)


def cross_blocks(left: DataFrame, right: DataFrame, left_key: str, right_key: str, body: Callable[[pa.Table, pa.Table], pa.Table], schema: str, per_block: int | None = None) -> DataFrame:
    """``body(left block, right block)`` for each pair of blocks."""
    nl, nr = n_blocks(left, per_block), n_blocks(right, per_block)
    left, right = fresh(left), fresh(right)
    a = left.withColumns({"_i": F.pmod(F.xxhash64(left_key), F.lit(nl)).cast("int"), "_j": F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))})
    b = right.withColumns({"_j": F.pmod(F.xxhash64(right_key), F.lit(nr)).cast("int"), "_i": F.explode(F.sequence(F.lit(0), F.lit(nl - 1)))})

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return body(x.drop_columns(["_i", "_j"]), y.drop_columns(["_i", "_j"]))

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInArrow(run, schema)


def edges(rows: DataFrame, key: str, vec: str, limit: float) -> DataFrame:
    """(a, b, sim) with a < b and sim > limit."""

    def body(x: pa.Table, y: pa.Table, same: bool) -> pa.Table:
        i, j = x.column(key).to_numpy(), y.column(key).to_numpy()
        if not len(i) or not len(j):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        s = matrix(x, vec) @ matrix(y, vec).T
        with np.errstate(invalid="ignore"):
            hit = s > limit
        if same:
            hit &= i[:, None] < j[None, :]
        p, q = np.nonzero(hit)
        return pa.table({"a": np.minimum(i[p], j[q]), "b": np.maximum(i[p], j[q]), "sim": s[p, q]})

    return self_blocks(rows.select(key, vec), key, body, "a long, b long, sim double")


def linked(rows: DataFrame, key: str, vec: str, limit: float) -> DataFrame:
    """(a, b): edges that have the connected components of all pairs with sim > limit, a few for each pair of blocks.

    Rows of one block are joined first; of the pairs of two blocks only a forest of these parts is left.
    """
    n = n_blocks(rows, WIDE * ROWS)
    cut = rows.select(F.col(key).cast("long").alias("k"), F.col(vec).alias("v")).withColumn("_b", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))

    def above(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return x @ y.T > limit

    def inside(t: pa.Table) -> pa.Table:
        k, v = t.column("k").to_numpy(), flat_matrix(t, "v")
        hit = np.concatenate([above(v[i : i + TILE], v) for i in range(0, len(k), TILE)])
        part, left = k.copy(), np.ones(len(k), bool)
        for i in np.argsort(k):
            reached = np.array([i] if left[i] else [], int)
            while len(reached):
                part[reached], left[reached] = k[i], False
                reached = np.flatnonzero(hit[reached].any(0) & left)
        return pa.table({"k": k, "v": t.column("v"), "part": part})

    parts = durable(cut.groupBy("_b").applyInArrow(inside, "k long, v array<double>, part long"), "parts")

    def between(x: pa.Table, y: pa.Table, same: bool) -> pa.Table:
        a, b = x.column("part").to_numpy(), y.column("part").to_numpy()
        if same:
            k = x.column("k").to_numpy()
            return pa.table({"a": k[k != a], "b": a[k != a]})
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        (a, i1), (b, j1) = np.unique(a[i], return_index=True), np.unique(b[j], return_index=True)
        v, w = flat_matrix(x, "v")[i], flat_matrix(y, "v")[j]
        hit = np.zeros((len(v), len(b)), bool)
        for r in range(0, len(v), TILE):
            hit[r : r + TILE] = np.logical_or.reduceat(above(v[r : r + TILE], w), j1, axis=1)
        p, q = np.nonzero(np.logical_or.reduceat(hit, i1, axis=0))
        nodes, least = joined(a[p], b[q])
        return pa.table({"a": nodes[nodes != least], "b": least[nodes != least]})

    return self_blocks(parts, "k", between, "a long, b long", WIDE * ROWS)


def nearest(rows: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(idx, rank, dist): the k nearest other rows by cosine distance, clipped to [0, 2]. k per block, then k of these."""

    def body(x: pa.Table, y: pa.Table, same: bool) -> pa.Table:
        i, j = x.column(key).to_numpy(), y.column(key).to_numpy()
        ids, dist = [], []
        if len(i) and len(j):
            d = np.clip(1.0 - matrix(x, vec) @ matrix(y, vec).T, 0.0, 2.0)
            if same:
                d[i[:, None] == j[None, :]] = np.inf
            for own, m in ((i, d),) if same else ((i, d), (j, d.T)):
                best = np.sort(np.partition(m, min(k, m.shape[1]) - 1, axis=1)[:, :k], axis=1)
                ids.append(np.repeat(own, best.shape[1]))
                dist.append(best.ravel())
        ids, dist = (np.concatenate(ids), np.concatenate(dist)) if ids else (np.zeros(0, np.int64), np.zeros(0))
        ok = np.isfinite(dist)
        return pa.table({"idx": ids[ok], "dist": dist[ok]})

    each = self_blocks(rows.select(key, vec), key, body, "idx long, dist double")
    best = each.groupBy("idx").agg(F.slice(F.array_sort(F.collect_list("dist")), 1, k).alias("d"))
    return best.select("idx", F.posexplode("d").alias("rank", "dist")).withColumn("rank", F.col("rank") + 1)
