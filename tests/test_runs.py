"""From image files to folders of clusters, with stand-in models."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.config import config
from kinfold.functions import geometry as G
from kinfold.functions import models, pixels
from kinfold.operators import detect
from kinfold.plans import runs
from kinfold.sources import images, state

CFG = config("dog", algorithm="agglomerative", distance_threshold=0.05)


def png(path, bgr, width=120, height=90):
    """A PNG of one colour, with a gradient so that rows differ."""
    raw = b"".join(b"\0" + bytes([bgr[2], bgr[1], min(255, bgr[0] + y // 30)]) * width for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def factory():
    def faces(batch):
        red, green, blue = batch[0, :, 320, 320]
        if green > 0.9:  # a green image has no face
            return np.zeros((1, 3, 13))
        if green > 0.5:
            raise RuntimeError("the detector fails")
        face = [320, 320, 200, 200, 0.9, 290, 300, 350, 310, 320, 340, 0.9, 0.2]
        return np.array([[face, [100, 100, 50, 50, 0.4, *face[5:]], [1, 1, 1, 1, 0.3, *face[5:]]]])

    def bodies(image):
        return [[10, 10, 100, 80, 0.9, 16], [0, 0, 9, 9, 0.95, 15], [0, 0, 120, 90, 0.2, 16]]

    vector = lambda x: x[0].reshape(3, -1).mean(1)
    return models.processor(models.Models(faces, bodies, vector, vector), 16)


def test_batch_and_add(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for i in range(3):
        png(src / f"d{i}" / "a.png", (20, 10, 220))
        png(src / f"d{i}" / "b.png", (220, 10, 20))
    png(src / "green.png", (10, 255, 10))
    png(src / "fails.png", (10, 200, 10))
    (src / "broken.png").write_bytes(b"no image")
    os.symlink(src / "d0" / "a.png", src / "z_link.png")
    (out / "cluster_009").mkdir(parents=True)
    with pytest.raises(ValueError, match="input|images"):
        (tmp_path / "none").mkdir()
        runs.batch(spark, str(tmp_path / "none"), str(out), CFG, factory, 3, 3)
    s = runs.batch(spark, str(src), str(out), CFG, factory, 3, 3)
    assert s == json.loads((out / "summary.json").read_text())
    assert s["total_images"] == 9 and s["config"]["coco_class"] == 16 and {"rescue_count", "body_cluster_count", "merge_count"} <= set(s)
    assert not (out / "cluster_009").exists()
    got = {f: sorted(os.listdir(out / f)) for f in os.listdir(out) if f.startswith(("cluster", "uncl"))}
    assert ["a.png", "a_1.png", "a_2.png"] in got.values() and ["b.png", "b_1.png", "b_2.png"] in got.values()
    assert "broken.png" in got["unclustered"] and "fails.png" in got["unclustered"]
    assert os.path.realpath(out / "cluster_001" / os.listdir(out / "cluster_001")[0]).startswith(str(src))
    rows = {os.path.relpath(r["path"], src): r for r in state.load(spark, str(out / "state")).rows.collect()}
    assert "z_link.png" not in rows and not rows["green.png"]["has_face"] and rows["green.png"]["has_body"]
    assert not rows["fails.png"]["has_body"] and not rows["broken.png"]["has_face"]
    assert runs.add(spark, str(src), str(out / "state"), str(out), factory) is None
    png(src / "late" / "a.png", (21, 10, 219))
    png(src / "late" / "c.png", (120, 10, 120))
    t = runs.add(spark, str(src), str(out / "state"), str(out), factory, link=False)
    assert (t["total_images"], t["new_images"], t["mode"], t["assigned_to_existing"]) == (11, 2, "incremental", 2)
    again = {os.path.relpath(r["path"], src): r["label"] for r in state.load(spark, str(out / "state")).rows.collect()}
    assert again["late/a.png"] == again["d0/a.png"] != again["d0/b.png"]
    assert not os.path.islink(out / "cluster_001" / os.listdir(out / "cluster_001")[0])


def test_no_faces_end_a_batch(spark, tmp_path):
    png(tmp_path / "in" / "green.png", (10, 255, 10))
    with pytest.raises(ValueError, match="no face"):
        runs.batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), CFG, factory, 3, 3)


def test_a_save_that_stops_loses_nothing(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.createDataFrame([(i, f"p{i}", [1.0], [1.0], True, True, 0) for i in range(5)], "idx long, path string, face array<double>, body array<double>, has_face boolean, has_body boolean, label int")
    assert not state.exists(spark, folder)
    assert state.save(state.State(rows, 1, 1, CFG), folder) == 1
    rows.limit(2).write.parquet(f"{folder}/v-000000002/rows")  # stops before its metadata
    assert state.load(spark, folder).rows.count() == 5
    assert state.save(state.State(rows.limit(3), 1, 1, CFG), folder) == 3
    assert state.load(spark, folder).rows.count() == 3
    (tmp_path / "e").mkdir()
    with pytest.raises(ValueError, match="no whole version"):
        state.load(spark, str(tmp_path / "e"))


def test_pixels_agree_with_columns(spark):
    """The best face of raw predictions, by arrays and by columns."""
    rng = np.random.default_rng(7)
    w, h = 500, 300
    pred = np.concatenate([rng.uniform(100, 500, (30, 2)), rng.uniform(20, 200, (30, 2)), rng.uniform(0, 1, (30, 1)), rng.uniform(0, 640, (30, 6)), rng.uniform(0, 1, (30, 2))], 1)
    _, scale, px, py = pixels.boxed(np.zeros((h, w, 3), np.uint8))
    box, lm = pixels.best_face(pred[None], scale, px, py, w, h, 0.3)
    d = spark.createDataFrame([(0, w, h, *map(float, p[:5]), p[5:11].tolist(), p[11:].tolist()) for p in pred], "image long, w int, h int, cx double, cy double, bw double, bh double, obj double, lm array<double>, cls array<double>")
    got = detect.best_faces(detect.faces(d)).first()
    assert box == [got["x1"], got["y1"], got["x2"], got["y2"]] and np.allclose(lm.ravel(), got["lm"])
    assert pixels.best_face(np.zeros((1, 5, 11)), scale, px, py, w, h, 0.3) is None
    assert detect.faces(d.where("obj < 0.3")).count() == 0


def test_alignment():
    image = np.zeros((100, 100, 3), np.uint8)
    image[40:60] = 200
    assert pixels.aligned(image, [10, 10, 50, 50], np.array([[20, 20], [24, 20], [22, 22]], float)) is None  # eyes too close
    assert pixels.aligned(image, [10, 10, 50, 50], np.array([[20, 20], [40, 20], [30, 30]], float)).shape == (40, 40, 3)
    assert pixels.aligned(image, [60, 60, 60, 60], np.array([[20, 20], [40, 20], [30, 30]], float)) is None  # nothing left
    turned = pixels.aligned(image, [10, 10, 50, 50], np.array([[20, 20], [40, 40], [30, 30]], float))
    assert turned.shape == (48, 48, 3)
    assert pixels.body_of(image, np.array([10.9, 10.9, 50.2, 50.2])).shape == (46, 46, 3)


def test_scan_resolves_links(spark, tmp_path):
    png(tmp_path / "x.png", (1, 2, 3))
    os.symlink(tmp_path / "x.png", tmp_path / "y.png")
    got = images.scan(spark, str(tmp_path)).orderBy("path").select("path", "resolved").collect()
    assert [os.path.basename(r["resolved"]) for r in got] == ["x.png", "x.png"]
    assert images.deduplicated(images.scan(spark, str(tmp_path))).count() == 1
    assert images.decoded(spark, str(tmp_path)).select(F.max("content.height")).first()[0] == 90


def test_providers_warn(caplog):
    assert models.providers(True, ["CPUExecutionProvider"]) == ["CPUExecutionProvider"] and "CUDA" in caplog.text
    assert models.providers(True, ["CUDAExecutionProvider"])[0] == "CUDAExecutionProvider"
    assert G.DETECT_SIZE == 640
