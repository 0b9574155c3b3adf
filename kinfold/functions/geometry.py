"""Box geometry as column arithmetic. Casts to int truncate toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DETECT_SIZE = 640
PAD_VALUE = 114
MIN_EYE_DISTANCE = 5.0
LEVEL_ANGLE = 1.0
BODY_MARGIN = 0.1
FACE_MARGIN = 0.1
IOU_EPS = 1e-6


def _int(c: Column) -> Column:
    return c.cast("int")


def letterbox(w: Column, h: Column, size: int = DETECT_SIZE) -> dict[str, Column]:
    """scale, new size and centred padding of an image put into a square."""
    scale = F.least(size / h, size / w)
    new_w, new_h = _int(w * scale), _int(h * scale)
    return {"scale": scale, "new_w": new_w, "new_h": new_h, "pad_x": _int((size - new_w) / 2), "pad_y": _int((size - new_h) / 2)}


def corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def unletterbox(box: dict[str, Column], scale: Column, pad_x: Column, pad_y: Column, w: Column, h: Column) -> dict[str, Column]:
    """Back to image coordinates; the first corner is clamped at 0, the second at the image's size."""
    zero = F.lit(0.0)
    return {
        "x1": _int(F.greatest((box["x1"] - pad_x) / scale, zero)),
        "y1": _int(F.greatest((box["y1"] - pad_y) / scale, zero)),
        "x2": _int(F.least((box["x2"] - pad_x) / scale, w.cast("double"))),
        "y2": _int(F.least((box["y2"] - pad_y) / scale, h.cast("double"))),
    }


def landmarks(lm: Column, scale: Column, pad_x: Column, pad_y: Column, w: Column, h: Column) -> Column:
    """Landmarks x, y, x, y, ... back to image coordinates, clamped at both sides."""

    def one(v: Column, i: Column) -> Column:
        x = i % 2 == 0
        return F.least(F.greatest((v - F.when(x, pad_x).otherwise(pad_y)) / scale, F.lit(0.0)), F.when(x, w).otherwise(h).cast("double"))

    return F.transform(lm, one)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / (area(a) + area(b) - w * h + F.lit(IOU_EPS))


def eye_geometry(lx: Column, ly: Column, rx: Column, ry: Column) -> dict[str, Column]:
    """Distance and angle of the eyes, and whether the face is usable and level."""
    distance = F.hypot(rx - lx, ry - ly)
    angle = F.degrees(F.atan2(ry - ly, rx - lx))
    return {"eye_distance": distance, "angle": angle, "usable": ~(distance < MIN_EYE_DISTANCE), "level": F.abs(angle) < LEVEL_ANGLE}


def face_crop(x1: Column, y1: Column, x2: Column, y2: Column, level: Column, w: Column, h: Column) -> dict[str, Column]:
    """The crop of a face: the box itself if level, else expanded by a tenth a side after rotation; clamped."""
    mx, my = _int((x2 - x1) * FACE_MARGIN), _int((y2 - y1) * FACE_MARGIN)
    zero = F.lit(0)
    return {
        "fx1": F.greatest(F.when(level, _int(x1)).otherwise(_int(x1) - mx), zero),
        "fy1": F.greatest(F.when(level, _int(y1)).otherwise(_int(y1) - my), zero),
        "fx2": F.least(F.when(level, _int(x2)).otherwise(_int(x2) + mx), w),
        "fy2": F.least(F.when(level, _int(y2)).otherwise(_int(y2) + my), h),
    }


def body_crop(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, margin: float = BODY_MARGIN) -> dict[str, Column]:
    """Coordinates are truncated first, then padded and clamped."""
    a, b, c, d = _int(x1), _int(y1), _int(x2), _int(y2)
    px, py = _int((c - a) * margin), _int((d - b) * margin)
    return {"bx1": F.greatest(a - px, F.lit(0)), "by1": F.greatest(b - py, F.lit(0)), "bx2": F.least(c + px, w), "by2": F.least(d + py, h)}


def big_enough(box: dict[str, Column], least: int = 32) -> Column:
    return (box["by2"] - box["by1"] >= least) & (box["bx2"] - box["bx1"] >= least)


def nms_keep(boxes: Column, limit: float = 0.5) -> Column:
    """Greedy suppression over an array of structs (conf, x1, y1, x2, y2, ...): conf descending, IoU over ``limit`` drops.

    Equal scores go by the later fields, so the result does not depend on the input's order.
    """
    fields = ("x1", "y1", "x2", "y2")
    ranked = F.sort_array(boxes, asc=False)

    def step(kept, box):
        hit = F.exists(kept, lambda k: iou({f: k[f] for f in fields}, {f: box[f] for f in fields}) > F.lit(limit))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(box)))

    return F.aggregate(ranked, F.slice(ranked, 1, 0), step)
