"""Pixel steps that models need, on numpy arrays; used inside model factories."""

from __future__ import annotations

import numpy as np

from ..config import FACE_CROP, IMAGENET_MEAN, IMAGENET_STD
from .geometry import BODY_MARGIN, DETECT_SIZE, FACE_MARGIN, LEVEL_ANGLE, MIN_EYE_DISTANCE, PAD_VALUE


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = image.astype(np.float32)
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def boxed(image: np.ndarray, size: int = DETECT_SIZE) -> tuple[np.ndarray, float, int, int]:
    """(image scaled into a padded square, scale, left padding, top padding)."""
    h, w = image.shape[:2]
    scale = min(size / h, size / w)
    nw, nh = int(w * scale), int(h * scale)
    px, py = (size - nw) // 2, (size - nh) // 2
    out = np.full((size, size, 3), PAD_VALUE, np.float32)
    out[py : py + nh, px : px + nw] = resize(image, nw, nh)
    return out, scale, px, py


def model_input(crop_bgr: np.ndarray, size: int = FACE_CROP) -> np.ndarray:
    """BGR crop to a normalised RGB batch of one, channels first."""
    rgb = resize(crop_bgr, size, size)[:, :, ::-1] / 255.0
    norm = (rgb - np.array(IMAGENET_MEAN, np.float32)) / np.array(IMAGENET_STD, np.float32)
    return np.ascontiguousarray(norm.transpose(2, 0, 1)[None], np.float32)


def turned(image: np.ndarray, cx: float, cy: float, degrees: float) -> np.ndarray:
    """Rotated about a point by ``degrees`` (the eyes' line becomes level); borders repeat."""
    h, w = image.shape[:2]
    t = np.deg2rad(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float32)
    dx, dy = xx - cx, yy - cy
    sx = np.clip(cx + dx * np.cos(t) - dy * np.sin(t), 0, w - 1)
    sy = np.clip(cy + dx * np.sin(t) + dy * np.cos(t), 0, h - 1)
    return image[np.rint(sy).astype(int), np.rint(sx).astype(int)]


def detector_input(image_bgr: np.ndarray, size: int = DETECT_SIZE) -> tuple[np.ndarray, float, int, int]:
    """(RGB batch of one in [0, 1], channels first; scale and paddings) of a letterboxed image."""
    out, scale, px, py = boxed(image_bgr[:, :, ::-1], size)
    return np.ascontiguousarray((out / 255.0).transpose(2, 0, 1)[None], np.float32), scale, px, py


def best_face(pred: np.ndarray, scale: float, px: int, py: int, width: int, height: int, limit: float) -> tuple[list[int], np.ndarray] | None:
    """(box, landmarks as rows x, y) of the surest face of raw predictions, in image coordinates.

    Suppression is left out: it never drops the surest face.
    """
    pred = np.asarray(pred, float).reshape(-1, np.shape(pred)[-1])
    pred = pred[pred[:, 4] > limit]
    if not len(pred):
        return None
    score = pred[:, 4] * (pred[:, 11:].max(1) if pred.shape[1] > 11 else 1.0)
    cx, cy, w, h = (p := pred[int(score.argmax())])[:4]
    corner = (np.array([cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]) - [px, py, px, py]) / scale
    box = [int(max(0, corner[0])), int(max(0, corner[1])), int(min(width, corner[2])), int(min(height, corner[3]))]
    return box, np.clip((p[5:11].reshape(3, 2) - [px, py]) / scale, 0, [width, height])


def aligned(image: np.ndarray, box: list[int], eyes: np.ndarray) -> np.ndarray | None:
    """The face with its eyes made level; None if the eyes are too close or nothing is left."""
    h, w = image.shape[:2]
    dx, dy = eyes[1] - eyes[0]
    if np.hypot(dx, dy) < MIN_EYE_DISTANCE:
        return None
    x1, y1, x2, y2 = box
    angle = float(np.degrees(np.arctan2(dy, dx)))
    if abs(angle) >= LEVEL_ANGLE:
        image = turned(image, (x1 + x2) / 2, (y1 + y2) / 2, angle)
        mx, my = (x2 - x1) * FACE_MARGIN, (y2 - y1) * FACE_MARGIN
        x1, y1, x2, y2 = int(x1 - mx), int(y1 - my), min(w, int(x2 + mx)), min(h, int(y2 + my))
    crop = image[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
    return crop if crop.size else None


def body_of(image: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The body with a margin; coordinates are truncated first."""
    h, w = image.shape[:2]
    px, py = int((box[2] - box[0]) * BODY_MARGIN), int((box[3] - box[1]) * BODY_MARGIN)
    x1, y1, x2, y2 = (int(v) for v in box)
    return image[max(0, y1 - py) : max(0, min(h, y2 + py)), max(0, x1 - px) : max(0, min(w, x2 + px))]
