"""Model inference behind a pluggable interface: one model per worker, Arrow batches, errors as rows.

A ``factory()`` runs once in each task and returns ``embed(image) -> (face, body)``, either
vector None if not found. ``processor()`` is the whole chain from pixels to vectors over four
models; ONNX sessions are one source of models, tests use small functions.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MIN_BODY_CROP
from . import pixels

OBJECTNESS = BODY_CONFIDENCE = 0.3

OUT = "idx long, path string, face array<double>, body array<double>, has_face boolean, has_body boolean, error string"


def _unit(v) -> list[float] | None:
    """v / |v|; a zero vector stays zero and still counts as found."""
    if v is None:
        return None
    v = [float(x) for x in v]
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n > 0 else v


def embedded(images: DataFrame, factory: Callable[[], Callable]) -> DataFrame:
    """Rows (idx, path, content) to vectors and flags. A failure gives an empty row with ``error``, whatever was found before.

    ``content`` is bytes or a decoded image (``images.decoded``); null is an image that cannot be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = factory()
        for batch in batches:
            face, body, error = [], [], []
            for content in batch.column("content").to_pylist():
                try:
                    if isinstance(content, dict):
                        content = np.frombuffer(content["data"], np.uint8).reshape(content["height"], content["width"], 3)
                    f, b = embed(content) if content is not None else (None, None)
                    f, b, e = _unit(f), _unit(b), None
                except Exception as x:  # a bad image must not end the batch
                    f, b, e = None, None, f"{type(x).__name__}: {x}"
                face.append(f)
                body.append(b)
                error.append(e)
            yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("path"), pa.array(face, pa.list_(pa.float64())), pa.array(body, pa.list_(pa.float64())), pa.array([x is not None for x in face]), pa.array([x is not None for x in body]), pa.array(error, pa.string())], ["idx", "path", "face", "body", "has_face", "has_body", "error"])

    return images.select("idx", "path", "content").mapInArrow(run, OUT)


def filled(rows: DataFrame, face_dim: int, body_dim: int) -> DataFrame:
    """Zero vectors for missing ones."""
    return rows.withColumns({"face": F.coalesce("face", F.array_repeat(F.lit(0.0), face_dim)), "body": F.coalesce("body", F.array_repeat(F.lit(0.0), body_dim))})


def output_width(shape: list, probe: Callable[[], list[float]]) -> int:
    """A model's static output width, else the width of one dummy inference."""
    return shape[-1] if shape and isinstance(shape[-1], int) and shape[-1] > 0 else len(probe())


def providers(gpu: bool, available: list[str]) -> list[str]:
    """CUDA if asked for and there, else the CPU, with a warning if CUDA was asked for."""
    if gpu and "CUDAExecutionProvider" in available:
        return ["CUDAExecutionProvider", "CPUExecutionProvider"]
    if gpu:
        logging.getLogger("kinfold").warning("no CUDA provider is available: models run on the CPU")
    return ["CPUExecutionProvider"]


@dataclass(frozen=True)
class Models:
    """What ``processor()`` calls; each takes arrays and gives arrays.

    ``faces(batch)``: raw face predictions of a letterboxed image. ``bodies(image)``: rows (x1, y1,
    x2, y2, confidence, class). ``embed_face(batch)`` and ``embed_body(batch)``: a vector.
    """

    faces: Callable
    bodies: Callable
    embed_face: Callable
    embed_body: Callable


def processor(models: Models, coco_class: int) -> Callable:
    """``embed`` for ``embedded()``: a BGR image to (face, body), by detection, alignment, crop and embedding."""

    def embed(image: np.ndarray) -> tuple:
        h, w = image.shape[:2]
        batch, scale, px, py = pixels.detector_input(image)
        face = body = None
        if found := pixels.best_face(models.faces(batch), scale, px, py, w, h, OBJECTNESS):
            crop = pixels.aligned(image, found[0], found[1])
            if crop is not None:
                face = models.embed_face(pixels.model_input(crop))
        boxes = np.asarray(models.bodies(image), float).reshape(-1, 6)
        boxes = boxes[(boxes[:, 4] > BODY_CONFIDENCE) & (boxes[:, 5] == coco_class)]
        if len(boxes):
            crop = pixels.body_of(image, boxes[int(boxes[:, 4].argmax())][:4])
            if min(crop.shape[:2]) >= MIN_BODY_CROP:
                body = models.embed_body(pixels.model_input(crop))
        return face, body

    return embed


def onnx_session(path: str, gpu: bool = False) -> Callable:
    """A model file as a function of one input array to its first output."""
    import onnxruntime as ort

    session = ort.InferenceSession(path, providers=providers(gpu, ort.get_available_providers()))
    name = session.get_inputs()[0].name
    return lambda x: session.run(None, {name: x})[0]


def onnx_embedder(face_model: str, body_model: str, detector_model: str, body_detector: Callable[[], Callable], coco_class: int, gpu: bool = False) -> Callable:
    """A factory over ONNX models. ``body_detector()`` gives ``bodies(image)``, as detectors differ in what they put out."""

    def factory():
        face, body, detect = (onnx_session(m, gpu) for m in (face_model, body_model, detector_model))
        flat = lambda run: lambda x: run(x).ravel()
        return processor(Models(detect, body_detector(), flat(face), flat(body)), coco_class)

    return factory
