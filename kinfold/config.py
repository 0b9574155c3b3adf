"""Thresholds of the phases, per species.

A stored configuration names the clusterer ``algorithm``, the linkage limit
``distance_threshold`` and the model files ``face_model``, ``body_model``, ``detector_model``
and ``body_detector_model``; configurations stored by other tools under other names cannot be
read across.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

#: Fixed values.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
FACE_CROP = 224
MIN_BODY_CROP = 32
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)
ALGORITHMS = ("hdbscan", "agglomerative", "chinese_whispers")
DOG_CLASS, CAT_CLASS = 16, 15


@dataclass(frozen=True)
class SpeciesConfig:
    species: str
    face_model: str
    body_model: str
    detector_model: str
    body_detector_model: str
    coco_class: int
    face_weight: float
    body_rescue_threshold: float
    min_body_agreements: int
    body_merge_threshold: float
    face_veto_threshold: float = 0.05
    face_contradiction_threshold: float = 0.10
    min_cluster_size: int = 2
    min_samples: int = 2
    min_body_overlap_ratio: float = 0.5
    algorithm: str = "hdbscan"
    distance_threshold: float = 0.55
    cw_threshold: float = 0.45
    cw_iterations: int = 20
    seed: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> SpeciesConfig:
        """Unknown keys fail; missing keys that have a default pass."""
        try:
            values = json.loads(text)
        except ValueError as e:
            raise ValueError(f"Corrupt state file: the configuration is not JSON: {e}") from e
        return cls(**values)


def _preset(species: str, **values) -> SpeciesConfig:
    return SpeciesConfig(species, f"{species}_face.onnx", f"{species}_body.onnx", "face_detector.onnx", "body_detector.onnx", **values)


#: Fixed values.
PRESETS = {
    "dog": _preset("dog", coco_class=DOG_CLASS, face_weight=0.5, body_rescue_threshold=0.25, min_body_agreements=3, body_merge_threshold=0.35),
    "cat": _preset("cat", coco_class=CAT_CLASS, face_weight=0.3, body_rescue_threshold=0.20, min_body_agreements=2, body_merge_threshold=0.30),
}


def config(species: str, **changes) -> SpeciesConfig:
    if species not in PRESETS:
        raise ValueError(f"no such species: {species}")
    return SpeciesConfig(**asdict(PRESETS[species]) | changes)
