"""Ports for models: what a detector has to offer, fakes for tests, and ONNX adapters.

A port is a picklable object with a method of one image; a Python worker loads its model once, with the
first image. Builders fail at once on an empty path.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from shutterloom.functions import faces
from shutterloom.functions import images as I


@lru_cache(maxsize=8)
def session(path: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def _run(path: str, tensor: np.ndarray) -> list[np.ndarray]:
    s = session(path)
    return s.run(None, {s.get_inputs()[0].name: tensor})


def _needed(path: str, what: str) -> str:
    if not path:
        raise ValueError(f"{what} needs a model path")
    return path


@dataclass(frozen=True)
class FakeTextDetector:
    """Answers by path; an exception as an answer is raised."""

    answers: dict[str, bool | Exception] = field(default_factory=dict)
    default: bool = False

    def has_text(self, path: str, raw: bytes) -> bool:
        answer = self.answers.get(path, self.default)
        if isinstance(answer, Exception):
            raise answer
        return answer


@dataclass(frozen=True)
class FakeFaceAnalyzer:
    """Faces by path: dicts with is_blink and smile, or with what these follow from: mesh, left_closed, right_closed."""

    faces: dict[str, list | Exception] = field(default_factory=dict)

    def faces_of(self, path: str, rgb: np.ndarray) -> list[dict]:
        answer = self.faces.get(path, [])
        if isinstance(answer, Exception):
            raise answer
        return answer


class OnnxTextDetector:
    """A text-segmentation model: text if the share of probable pixels is large enough."""

    def __init__(self, path: str, threshold: float = 0.3, ratio: float = 0.005, most: int = 736):
        self.path, self.threshold, self.ratio, self.most = _needed(path, "text detection"), threshold, ratio, most

    def has_text(self, path: str, raw: bytes) -> bool:
        out = _run(self.path, I.text_input(I.decode(raw), self.most))[0]
        return float((out > self.threshold).mean()) > self.ratio


class OnnxFaceAnalyzer:
    """Detector, embedder, mesh and eye-state models in a row; without an eye model eyes count as open. The models' files
    are not part of this package, and only the numbers between them are tested (``functions.faces``)."""

    def __init__(self, detector: str, embedder: str, mesh: str, eyes: str | None = None, least: float = 0.5, overlap: float = 0.4, eye_share: float = 0.1):
        self.detector, self.embedder, self.mesh = _needed(detector, "face detection"), _needed(embedder, "face embedding"), _needed(mesh, "face mesh")
        self.eyes, self.least, self.overlap, self.eye_share = eyes, least, overlap, eye_share

    def _detected(self, rgb: np.ndarray) -> np.ndarray:
        tensor, factor = I.letterboxed(rgb, 640, 128, 127.5, 128, False)
        outputs = sorted(_run(self.detector, tensor), key=lambda o: (o.shape[-1], -o.shape[-2]))
        scores, boxes, points = (dict(zip((8, 16, 32), outputs[i : i + 3], strict=True)) for i in (0, 3, 6))
        return I.anchors_decoded(scores, boxes, points, 640, self.least, factor)

    def faces_of(self, path: str, rgb: np.ndarray) -> list[dict]:
        embed = lambda face: _run(self.embedder, ((face.astype(np.float32) - 127.5) / 127.5).transpose(2, 0, 1)[None])[0]
        return faces.analyzed(rgb, self._detected, embed, lambda x: _run(self.mesh, x)[0], lambda x: _run(_needed(self.eyes, "eye state"), x)[0], self.overlap, self.eye_share)
