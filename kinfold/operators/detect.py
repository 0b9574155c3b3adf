"""Detections from raw predictions, as DataFrame operators.

A face prediction is a row (image, w, h, cx, cy, bw, bh, obj, lm, cls): centre and size in the
letterboxed square, objectness, three landmarks as six coordinates and class scores (may be
empty). A body prediction is a row (image, cls, conf, x1, y1, x2, y2) in image coordinates.
The rows of one image are few, as a model gives a bounded number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Fixed values.
OBJECTNESS = 0.3
BODY_CONFIDENCE = 0.3


def faces(predictions: DataFrame, limit: float = OBJECTNESS, overlap: float = 0.5) -> DataFrame:
    """(image, rank, conf, x1, y1, x2, y2, lm): faces of each image in image coordinates, the surest first.

    Objectness must be over ``limit``; the score is objectness times the best class score and is
    not tested again. Equal scores go by the later coordinates.
    """
    p = predictions.where(F.col("obj") > limit)
    score = F.col("obj") * F.when(F.size("cls") > 0, F.array_max("cls")).otherwise(F.lit(1.0))
    box = G.corners(F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh"))
    found = p.groupBy("image", "w", "h").agg(F.collect_list(F.struct(score.alias("conf"), *[c.alias(n) for n, c in box.items()], "lm")).alias("_b"))
    d = found.select("image", "w", "h", F.posexplode(G.nms_keep(F.col("_b"), overlap)).alias("rank", "_b"))
    d = d.withColumns(G.letterbox(F.col("w"), F.col("h")))
    args = (F.col("scale"), F.col("pad_x"), F.col("pad_y"), F.col("w"), F.col("h"))
    out = G.unletterbox({n: F.col(f"_b.{n}") for n in ("x1", "y1", "x2", "y2")}, *args)
    return d.select("image", "rank", F.col("_b.conf").alias("conf"), *[c.alias(n) for n, c in out.items()], G.landmarks(F.col("_b.lm"), *args).alias("lm"))


def best_faces(found: DataFrame) -> DataFrame:
    """The surest face of each image, as ``faces()`` gives them."""
    return found.where("rank = 0").drop("rank")


def best_bodies(predictions: DataFrame, coco_class: int, limit: float = BODY_CONFIDENCE) -> DataFrame:
    """(image, conf, x1, y1, x2, y2): the surest body of the class over ``limit``; equal ones go by the least coordinates."""
    box = ("x1", "y1", "x2", "y2")
    own = predictions.where((F.col("cls") == coco_class) & (F.col("conf") > limit))
    best = own.groupBy("image").agg(F.min(F.struct((-F.col("conf")).alias("c"), *box)).alias("b"))
    return best.select("image", (-F.col("b.c")).alias("conf"), *[F.col(f"b.{n}").alias(n) for n in box])
