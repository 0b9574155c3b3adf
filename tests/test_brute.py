"""Clusterers, whole runs and block code against plain loops, at one and at several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import queries as Q
from kinfold.config import config
from kinfold.functions import vectors as V
from kinfold.operators import blocks, clusterers, graph, phases
from kinfold.operators import tables as T
from kinfold.plans import fixture

from . import brute

DOG = config("dog")


@pytest.fixture(scope="module")
def rows(spark, sf):
    return fixture.modalities(spark, sf).orderBy("idx").toPandas()


def as_rows(t, cfg, label=None):
    return brute.Rows(t["idx"], np.array(t["face"].tolist()), np.array(t["body"].tolist()), t["has_face"], t["has_body"], cfg, label)


def partition(labels):
    out = {}
    for i, c in labels.items():
        if c != -1:
            out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("per_block", [2048, 97])
@pytest.mark.parametrize("algorithm", sorted(clusterers.RUN))
def test_clusterers(spark, sf, rows, monkeypatch, algorithm, per_block):
    monkeypatch.setattr(blocks, "ROWS", per_block)
    name = {"chinese_whispers": "cluster_whispers"}.get(algorithm, f"cluster_{algorithm}")
    got = {r["idx"]: r["label"] for r in Q.QUERIES[name](spark, sf).collect()}
    t = rows[rows.has_face]
    idx = t["idx"].tolist()
    groups = brute.groups_of(algorithm, idx, np.array(t["face"].tolist()), config("dog", algorithm=algorithm))
    want = dict.fromkeys(idx, -1) | {idx[i]: min(idx[k] for k in g) for g in groups for i in g}
    assert got == want and len(partition(want)) > 2


def test_pipeline_batch(spark, sf, rows):
    want = brute.batch(as_rows(rows, DOG))
    got = {r["idx"]: r["label"] for r in Q.QUERIES["pipeline_batch"](spark, sf).collect()}
    assert got == want and len(partition(want)) > 2


def test_pipeline_add(spark, sf, rows):
    first, more = rows[rows.idx % 4 != 0], rows[rows.idx % 4 == 0]
    old = as_rows(first, DOG)
    brute.batch(old)
    more = more.assign(key=more["path"] + "#" + more["idx"].map("{:08d}".format)).sort_values("key").reset_index(drop=True)
    more["idx"] = first["idx"].max() + 1 + more.index
    want = brute.add(old, as_rows(more, DOG))
    got = {r["idx"]: r["label"] for r in Q.QUERIES["pipeline_add"](spark, sf).collect()}
    assert got == want and len(partition(want)) > 2


@pytest.mark.parametrize("name", ["sim_edges", "knn_topk", "rescue_stats", "assign_centroid", "merge_stats", "core_distance"])
def test_blocks_do_not_matter(spark, sf, monkeypatch, name):
    one = sorted(map(str, Q.QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(blocks, "ROWS", 97)
    assert sorted(map(str, Q.QUERIES[name](spark, sf).collect())) == one


def test_median_by_counts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(k, [float(x) for x in v]) for k, n in ((1, 1), (2, 2), (3, 51), (4, 400)) for v in np.round(rng.normal(size=(n, 3)), 1 if k == 4 else 6)]
    data += [(5, [0.0, 1.0, float(i % 2)]) for i in range(30)]
    d = spark.createDataFrame(data, "c int, v array<double>")
    want = {k: np.median([v for c, v in data if c == k], axis=0).tolist() for k in range(1, 6)}
    monkeypatch.setattr(V, "MEDIAN_CELLS", 4)
    for most in (1_000_000, 0):
        monkeypatch.setattr(V, "MEDIAN_ROWS", most)
        got = {r["c"]: r["m"] for r in V.median_vector(d, "c", "v", "m").collect()}
        assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want) and len(got) == 5


def test_numbered(spark):
    d = spark.createDataFrame([(f"p{i * 37 % 101:03d}",) for i in range(101)], "path string").repartition(7)
    got = {r["path"]: r["i"] for r in T.numbered(d, ["path"], "i", 10).collect()}
    assert got == {f"p{i:03d}": 10 + i for i in range(101)}
    assert T.numbered(d.limit(0), ["path"], "i").collect() == []


def test_components_that_do_not_settle_fail(spark):
    nodes = spark.range(40).withColumnRenamed("id", "node")
    path = spark.createDataFrame([(i, i + 1) for i in range(39)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(nodes, path, rounds=2)


def test_mean_similarity_needs_no_pairs(spark, rows):
    r = as_rows(rows, DOG, rows["label"])
    d = spark.createDataFrame(rows)
    for x in phases.rescue_stats(d, DOG).where(F.col("idx") % 5 == 0).collect():
        m = np.flatnonzero((r.label == x["cluster"]) & r.has_body)
        s = r.body[m] @ r.body[np.flatnonzero(r.idx == x["idx"])[0]]
        assert x["n_agree"] == (s > 0.25).sum() and abs(x["avg_sim"] - s.mean()) < 1e-9
