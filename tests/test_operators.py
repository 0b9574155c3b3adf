import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.config import PRESETS, SpeciesConfig, config
from kinfold.functions import geometry as G
from kinfold.functions import models, pixels
from kinfold.functions import vectors as V
from kinfold.operators import blocks, clusterers, graph, phases
from kinfold.operators import tables as T
from kinfold.operators.graph import components
from kinfold.plans import fixture, identify
from kinfold.sources import images, state
from kinfold.streaming import incremental

from . import brute

ROW = "idx long, path string, face array<double>, body array<double>, has_face boolean, has_body boolean, label int"
DOG = config("dog")


def frame(spark, rows):
    full = [(i, f"p{i:03d}.jpg", f or [0.0, 0.0], b or [0.0, 0.0], f is not None, b is not None, c) for i, f, b, c in rows]
    return spark.createDataFrame(full, ROW)


def at(degrees):
    t = math.radians(degrees)
    return [math.cos(t), math.sin(t)]


def partition(rows):
    groups = {}
    for r in rows.collect():
        if r["label"] != -1:
            groups.setdefault(r["label"], set()).add(r["idx"])
    return sorted(map(sorted, groups.values()))


def test_config():
    assert SpeciesConfig.from_json(PRESETS["cat"].to_json()) == PRESETS["cat"]
    with pytest.raises(ValueError, match="Corrupt state file"):
        SpeciesConfig.from_json("{")
    with pytest.raises(TypeError):
        SpeciesConfig.from_json(json.dumps(json.loads(DOG.to_json()) | {"other": 1}))
    short = {k: v for k, v in json.loads(DOG.to_json()).items() if k != "seed"}
    assert SpeciesConfig.from_json(json.dumps(short)) == DOG
    with pytest.raises(ValueError):
        config("bird")


def test_nan_is_never_above(spark):
    r = spark.createDataFrame([(float("nan"),), (0.3,), (0.25,)], "x double")
    assert [x[0] for x in r.select(V.above(F.col("x"), 0.25)).collect()] == [False, True, False]
    assert [x[0] for x in r.select(V.below(F.col("x"), 0.3)).collect()] == [False, False, True]


def test_normalise_zero(spark):
    r = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [x[0] for x in r.select(V.normalise(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_median_is_exact_for_even_counts(spark):
    r = spark.createDataFrame([(1, [x]) for x in (1.0, 2.0, 3.0, 10.0)], "c int, v array<double>")
    assert V.median_vector(r, "c", "v", "m").first()["m"] == [2.5]


def test_components(spark):
    nodes = spark.range(12).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(0, 1), (2, 1), (3, 2), (4, 3), (7, 8), (8, 7), (9, 9)], "a long, b long")
    got = dict(components(nodes, edges).collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11}


def test_rescue_tie_goes_to_first_body_and_veto(spark):
    rows = [(i, at(0), at(0), 1) for i in (10, 11, 12)] + [(i, at(0), at(0), 0) for i in (13, 14, 15)]
    rows += [(20, None, at(0), -1), (21, at(90), at(0), -1), (22, None, None, -1), (23, None, at(90), -1)]
    r = frame(spark, rows)
    log = {x["idx"]: x for x in phases.rescue(r, phases.face_centroids(r), DOG).collect()}
    assert (log[20]["action"], log[20]["cluster"], log[20]["n_agree"]) == ("rescued", 1, 3)
    assert (log[21]["action"], log[21]["cluster"], log[21]["proposed_cluster"]) == ("vetoed", None, 1)
    assert log[21]["reason"] == "face_sim=0.0000"
    assert log[22]["action"] == "no_body"
    assert log[23]["action"] == "insufficient"


def test_agreement_is_strict(spark):
    # similarity equal to the threshold does not agree
    v = [0.25, math.sqrt(1 - 0.0625)]
    r = frame(spark, [(i, None, [1.0, 0.0], 0) for i in range(3)] + [(9, None, v, -1)])
    assert phases.rescue(r, phases.face_centroids(r), DOG).first()["action"] == "insufficient"


def test_merge_chain_joins_blocked_pair(spark):
    # A-B and B-C merge; A-C contradict by face but all three join through B, which has no faces
    rows = [(0, at(0), at(0), 0), (1, at(0), at(0), 0), (2, None, at(1), 1), (3, None, at(1), 1), (4, at(90), at(2), 2), (5, at(90), at(2), 2)]
    r = frame(spark, rows)
    d = {(x["c1"], x["c2"]): x["blocked"] for x in phases.merge_decisions(r, DOG).collect()}
    assert d == {(0, 1): False, (1, 2): False, (0, 2): True}
    merged, log = identify.merge_phase(r, DOG)
    assert partition(merged) == [[0, 1, 2, 3, 4, 5]]
    assert sorted((x["action"], tuple(x["clusters"])) for x in log.collect()) == [("blocked", (0, 2)), ("merged", (0, 1)), ("merged", (1, 2))]


def test_assign_ties_and_modalities(spark):
    old = frame(spark, [(0, at(0), at(0), 3), (1, at(0), at(0), 2), (2, None, at(90), 5)])
    new = frame(spark, [(0, at(0), at(0), -1), (1, None, at(90), -1), (2, None, None, -1), (3, at(180), None, -1)])
    got = {x["idx"]: (x["cluster"], round(x["score"], 6)) for x in phases.assign(new, old, DOG).collect()}
    assert got == {0: (2, 1.0), 1: (5, 1.0)}


def test_filenames_skip_taken_names(spark):
    names = ["x/a.jpg", "y/a.jpg", "z/a_1.jpg"]
    for order in (names, names[::-1]):
        r = spark.createDataFrame([(i, p, 0) for i, p in enumerate(order)], "idx long, path string, label int")
        got = [x["filename"] for x in T.filenames(r).orderBy("idx").collect()]
        assert len(set(got)) == 3
        assert got == (["a.jpg", "a_1.jpg", "a_1_1.jpg"] if order is names else ["a_1.jpg", "a.jpg", "a_2.jpg"])


def test_renumber(spark):
    r = spark.createDataFrame([(0, 7), (1, -1), (2, 3), (3, 7)], "idx long, label int")
    once = T.renumber(r)
    assert [x["label"] for x in once.orderBy("idx").collect()] == [1, -1, 0, 1]
    assert [x["label"] for x in T.renumber(once).orderBy("idx").collect()] == [1, -1, 0, 1]


def test_summary(spark):
    r = spark.createDataFrame([(0, "a/x.jpg", 4), (1, "a/y.jpg", 4), (2, "b.jpg", -1)], "idx long, path string, label int")
    s = T.summary(r, "dog", DOG.to_json(), 1.236, mode="incremental", new_images=1).first()
    out = json.loads(s["json"])
    assert (out["total_images"], out["n_clusters"], out["n_unclustered"], out["cluster_sizes"]) == (3, 1, 1, {"cluster_001": 2})
    assert (out["elapsed_seconds"], out["mode"], out["config"]["species"]) == (1.24, "incremental", "dog")


def test_new_rows_has_two_keys(spark):
    found = spark.createDataFrame([("r/a", "/r/a"), ("r/b", "/r/b"), ("r/c", "/r/c")], "path string, resolved string")
    stored = spark.createDataFrame([("r/a",), ("/r/b",), (None,)], "path string")
    assert [x["path"] for x in T.new_rows(found, stored).collect()] == ["r/c"]


def test_linkage_and_whispers():
    pts = [0, 1, 40, 41, 120]
    d = np.array([[1 - math.cos(math.radians(a - b)) for b in pts] for a in pts])
    lab = clusterers.linkage(d, 0.05)
    assert len({lab[0], lab[1]}) == 1 and len({lab[2], lab[3]}) == 1 and len(set(lab)) == 3
    e = pd.DataFrame({"a": [1, 5], "b": [2, 6], "sim": [0.9, 0.8]})
    lab = clusterers.whisper(np.array([1, 2, 5, 6, 9]), e, 20, 0)
    assert lab[0] == lab[1] != lab[2] == lab[3] and lab[4] == -1


def test_linkage_and_whispers_of_rows():
    """Vectors alone give what distances and edges give, copies of rows included."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6, 12))[rng.integers(0, 6, 300)] + rng.normal(0, 0.8, (300, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = np.concatenate([v, v[:60], v[:30]])
    sim = v @ v.T
    for limit in (0.2, 0.4, 0.55):
        groups = brute.average_linkage(np.clip(1.0 - sim, 0.0, 2.0), limit)
        want = np.zeros(len(v), int)
        for g in groups:
            want[g] = min(g)
        assert clusterers.average_groups(v, limit).tolist() == want.tolist() and len(groups) > 2
    ids = np.arange(len(v)) * 3
    for limit in (0.9, 0.6):
        a, b = np.nonzero(np.triu(sim > limit, 1))
        want = clusterers.whisper(ids, pd.DataFrame({"a": ids[a], "b": ids[b], "sim": sim[a, b]}), 20, 0)
        assert clusterers.whisper_rows(ids, v, limit, 20, 0).tolist() == want.tolist() and len(set(want)) > 2


def test_linkage_of_many_rows_needs_no_matrix():
    import tracemalloc

    rng = np.random.default_rng(4)
    v = rng.normal(size=(4, 16))[np.arange(6000) % 4] + rng.normal(0, 0.3, (6000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    lab = clusterers.average_groups(v, 0.55)
    w = clusterers.whisper_rows(np.arange(6000), v, 0.45, 20, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 6000 * 8 / 2 and len(set(lab)) == len(set(w)) == 4


def test_linked_has_components_of_all_pairs_in_few_edges(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 40)
    monkeypatch.setattr(blocks, "WIDE", 1)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(5, 8))[np.arange(300) % 5] + rng.normal(0, 0.35, (300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    r = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "idx long, vec array<double>").cache()
    nodes = r.select(r.idx.alias("node"))
    for limit in (0.88, 0.97):
        few, all_ = blocks.linked(r, "idx", "vec", limit), blocks.edges(r, "idx", "vec", limit)
        assert few.count() < all_.count()
        got, want = ({(x.node, x.component) for x in graph.components(nodes, e).collect()} for e in (few, all_))
        assert got == want and 2 < len({c for _, c in want}) < 300


def test_face_phase_forms_no_table_of_pairs(spark, sf, monkeypatch):
    def refused(*_):
        raise AssertionError("all pairs over a limit")

    rows = fixture.modalities(spark, sf).cache()
    for name in ("agglomerative", "chinese_whispers"):
        monkeypatch.setattr(blocks, "edges", refused)
        monkeypatch.setattr(clusterers, "linkage", refused)
        out = identify.face_phase(rows, config("dog", algorithm=name))
        assert out.where("has_face and label >= 0").count() > 0 == out.where("not has_face and label >= 0").count()


def test_face_phase_takes_missing_vectors_for_unlike_any(spark):
    r = frame(spark, [(i, at(d), None, -1) for i, d in enumerate((0, 1, 2, 90, 91, 92, 0))])
    r = r.withColumn("face", F.when(F.col("idx") != 6, F.col("face")))
    for name, own in (("agglomerative", 2), ("chinese_whispers", -1), ("hdbscan", -1)):
        got = {x["idx"]: x["label"] for x in identify.face_phase(r, config("dog", algorithm=name)).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: own}
    lost = r.withColumn("face", F.lit(None).cast("array<double>"))
    for name, want in (("agglomerative", list(range(7))), ("chinese_whispers", [-1] * 7), ("hdbscan", [-1] * 7)):
        assert [x["label"] for x in identify.face_phase(lost, config("dog", algorithm=name)).orderBy("idx").collect()] == want


def test_density_clusters():
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 0.05, (8, 2)), rng.normal(3, 0.05, (8, 2)), [[10.0, -10.0]]])
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    core = np.sort(d, axis=1)[:, 2]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    lab = clusterers.condensed(len(pts), clusterers.spanning_tree(reach), 8)
    assert len(set(lab[:8])) == 1 and len(set(lab[8:16])) == 1 and lab[0] != lab[8] and lab[16] == -1
    # one group alone: the root is not selectable
    one = clusterers.condensed(8, clusterers.spanning_tree(reach[:8, :8]), 8)
    assert set(one) == {-1}
    assert clusterers.condensed(1, [], 2).tolist() == [-1]


@pytest.mark.parametrize("algorithm", sorted(clusterers.RUN))
def test_clusterers_find_planted_groups(spark, algorithm):
    angles = [0, 1, 2, 3, 90, 91, 92, 93]
    r = spark.createDataFrame([(i, at(a)) for i, a in enumerate(angles)], "idx long, vec array<double>")
    # a second dimension apart keeps density clusters from splitting further
    got = {}
    for x in clusterers.cluster(r, config("dog", algorithm=algorithm)).collect():
        got.setdefault(x["label"], set()).add(x["idx"])
    for members in got.values():
        assert len({i // 4 for i in members}) == 1
    with pytest.raises(ValueError):
        clusterers.cluster(r, config("dog", algorithm="other"))


def test_batch_edges(spark):
    empty = frame(spark, [(0, None, None, -1)]).drop("label")
    assert identify.batch(empty, DOG, guarded=False).rows.first()["label"] == -1
    for rows in (empty, empty.limit(0)):
        with pytest.raises(ValueError):
            identify.batch(rows, DOG)
    one = frame(spark, [(0, at(0), at(0), -1), (1, None, at(90), -1)]).drop("label")
    assert {x["label"] for x in identify.face_phase(one, DOG).collect()} == {-1}


def test_add_without_news_and_stream(spark, tmp_path):
    cfg = config("dog", algorithm="agglomerative")
    r = frame(spark, [(i, at(a), at(a), -1) for i, a in enumerate([0, 1, 90, 91])]).drop("label")
    first = identify.batch(r, cfg)
    assert partition(first.rows) == [[0, 1], [2, 3]]
    assert identify.add(first.rows, r, cfg).rows is first.rows
    more = r.where("idx = 0").withColumn("path", F.lit("q.jpg"))
    second = identify.add(first.rows, more, cfg)
    assert second.assigned == 1 and partition(second.rows) == [[0, 1, 4], [2, 3]]
    folder, src = str(tmp_path / "state"), str(tmp_path / "in")
    r.write.parquet(src)
    stream = spark.readStream.schema(r.schema).parquet(src)
    incremental.start(stream, folder, cfg, 2, 2, str(tmp_path / "ck")).awaitTermination()
    more.write.mode("append").parquet(src)
    incremental.start(stream, folder, cfg, 2, 2, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(len, partition(state.load(spark, folder).rows))) == [2, 3]


def test_state_refuses_other_widths(spark, tmp_path):
    r = frame(spark, [(0, at(0), None, 0)])
    state.save(state.State(r, 2, 3, DOG), str(tmp_path / "s"))
    with pytest.raises(ValueError, match="Corrupt state file"):
        state.load(spark, str(tmp_path / "s"))


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in (".h.jpg", "_u.png", "c.Jpg", "a.jpg", "b.PNG", "d/e.webp", "t.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = [x["path"].removeprefix(str(tmp_path) + "/") for x in images.deduplicated(images.scan(spark, str(tmp_path))).orderBy("idx").collect()]
    assert got == ["a.jpg", "b.PNG", "d/e.webp"]


def test_embedder_errors_become_rows(spark):
    def factory():
        def embed(content):
            if content == b"bad":
                raise RuntimeError("no image")
            return [3.0, 4.0], None

        return embed

    r = spark.createDataFrame([(0, "a", bytearray(b"ok")), (1, "b", bytearray(b"bad")), (2, "c", None)], "idx long, path string, content binary")
    got = {x["idx"]: x for x in models.filled(models.embedded(r, factory), 2, 2).collect()}
    assert (got[0]["face"], got[0]["has_face"], got[0]["body"], got[0]["has_body"]) == ([0.6, 0.8], True, [0.0, 0.0], False)
    assert got[1]["error"] == "RuntimeError: no image" and not got[1]["has_face"]
    assert not got[2]["has_face"] and got[2]["error"] is None
    assert models.output_width([1, 512], lambda: []) == 512
    assert models.output_width([1, "n"], lambda: [0.0] * 7) == 7
    assert models.providers(True, ["CPUExecutionProvider"]) == ["CPUExecutionProvider"]


def test_pixels():
    image = np.full((50, 100, 3), 7, np.uint8)
    boxed, scale, px, py = pixels.boxed(image)
    assert (boxed.shape, scale, px, py) == ((640, 640, 3), 6.4, 0, 160)
    assert boxed[0, 0, 0] == 114 and boxed[320, 320, 0] == 7
    assert pixels.model_input(image).shape == (1, 3, 224, 224)
    assert (pixels.turned(image, 50, 25, 30) == 7).all()


def test_nms_keeps_equal_iou(spark):
    rows = [(0.9, 0.0, 0.0, 10.0, 10.0, 1), (0.8, 0.0, 0.0, 10.0, 10.0, 2), (0.7, 20.0, 0.0, 30.0, 10.0, 3)]
    r = spark.createDataFrame([(rows,)], "b array<struct<conf:double,x1:double,y1:double,x2:double,y2:double,id:int>>")
    assert [x["id"] for x in r.select(G.nms_keep(F.col("b"))).first()[0]] == [1, 3]
