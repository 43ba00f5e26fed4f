"""The numeric part of face analysis, without the models: crops, inputs, decoded outputs, suppression.

Images are (height, width, 3) arrays of bytes, boxes (x1, y1, x2, y2) in pixels.
"""

from __future__ import annotations

import numpy as np

from shutterloom.functions import images as I

#: Sides of the models' inputs, the grey around an eye, points of a mesh and their numbers, channels of an eye
#: state output (a box of four, open, closed).
EYE_SIDE, EYE_PAD, MESH_SIDE, MESH_POINTS, MESH_DIMS, EYE_CHANNELS, CLOSED = 640, 114, 192, 468, 3, 6, 5
#: Where the eyes, the nose and the corners of the mouth stand in an aligned face of 112 pixels (the
#: published ArcFace template).
ALIGNED = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])


def pixel(value: float, limit: int) -> int:
    """A coordinate as a whole number from 0 to the limit; NaN and negative ones give 0, infinity the limit."""
    if not value > 0:
        return 0
    return limit if value >= limit else int(value)


def cropped(rgb: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    """The part of an image, cut at its edges; a black pixel if nothing is left."""
    h, w = rgb.shape[:2]
    left, right, top, bottom = pixel(x1, w), pixel(x2, w), pixel(y1, h), pixel(y2, h)
    return rgb[top:bottom, left:right] if right > left and bottom > top else np.zeros((1, 1, 3), np.uint8)


def face_crop(rgb: np.ndarray, box: np.ndarray) -> np.ndarray:
    """A face by its box, to whole pixels."""
    return cropped(rgb, *(np.floor(max(float(v), 0.0) + 0.5) if np.isfinite(v) else float(v) for v in box))


def eye_crop(rgb: np.ndarray, centre: np.ndarray, box: np.ndarray, share: float) -> np.ndarray:
    """A square around an eye whose half side is a share of the face's height."""
    radius = np.floor(max(float(box[3] - box[1]), 1.0) * share + 0.5)
    x, y = (float(v) for v in centre)
    return cropped(rgb, x - radius, y - radius, x + radius, y + radius)


def eye_input(crop: np.ndarray) -> np.ndarray:
    """(1, 3, 640, 640): enlarged to the whole side, in the middle of grey, from 0 to 1."""
    h, w = crop.shape[:2]
    factor = EYE_SIDE / max(h, w)
    side = lambda n: min(EYE_SIDE, max(1, int(np.floor(n * factor + 0.5))))
    small = np.clip(np.round(I.resized(crop, side(h), side(w))), 0, 255)
    canvas = np.full((EYE_SIDE, EYE_SIDE, 3), float(EYE_PAD))
    top, left = (EYE_SIDE - small.shape[0]) // 2, (EYE_SIDE - small.shape[1]) // 2
    canvas[top : top + small.shape[0], left : left + small.shape[1]] = small
    return (canvas / 255).transpose(2, 0, 1)[None].astype(np.float32)


def mesh_input(crop: np.ndarray) -> np.ndarray:
    """(1, 3, 192, 192) from 0 to 1."""
    small = crop if crop.shape[:2] == (MESH_SIDE, MESH_SIDE) else np.clip(np.round(I.resized(crop, MESH_SIDE, MESH_SIDE)), 0, 255)
    return (small / 255).transpose(2, 0, 1)[None].astype(np.float32)


def closed_score(output: np.ndarray) -> float:
    """How surely an eye is closed: the largest such score of all anchors in a (1, 6, anchors) output, from 0 to 1."""
    if output.ndim != 3 or output.shape[0] != 1 or output.shape[1] != EYE_CHANNELS or not output.shape[2]:
        raise ValueError(f"an eye state has the shape (1, {EYE_CHANNELS}, anchors), not {output.shape}")
    scores = output[0, CLOSED].astype(np.float32)
    scores = scores[~np.isnan(scores)]
    return float(np.clip(scores.max(), 0, 1)) if len(scores) else 0.0


def mesh_points(output: np.ndarray) -> np.ndarray:
    """(468, 3) points of a mesh from a flat output."""
    flat = np.asarray(output, np.float32).reshape(-1)
    if len(flat) < MESH_POINTS * MESH_DIMS:
        raise ValueError(f"a mesh has {MESH_POINTS * MESH_DIMS} numbers, not {len(flat)}")
    return flat[: MESH_POINTS * MESH_DIMS].reshape(MESH_POINTS, MESH_DIMS)


def kept_boxes(boxes: np.ndarray, scores: np.ndarray, most: float) -> np.ndarray:
    """Places of the boxes that greedy suppression keeps, the best first: each takes out those after it that share more
    than ``most`` of their union with it. A step for each box kept, whatever it takes out."""
    order = np.argsort(-scores, kind="stable")
    b = boxes[order].astype(np.float64)
    area = np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)
    left, kept = np.arange(len(b)), []
    while len(left):
        i, left = left[0], left[1:]
        kept.append(i)
        w = np.maximum(np.minimum(b[left, 2], b[i, 2]) - np.maximum(b[left, 0], b[i, 0]), 0)
        h = np.maximum(np.minimum(b[left, 3], b[i, 3]) - np.maximum(b[left, 1], b[i, 1]), 0)
        union = area[left] + area[i] - w * h
        left = left[np.divide(w * h, union, out=np.zeros(len(left)), where=union > 0) <= most]
    return order[np.array(kept, np.int64)] if kept else np.zeros(0, np.int64)


def analyzed(rgb: np.ndarray, detect, embed, mesh, eye, overlap: float = 0.4, eye_share: float = 0.1) -> list[dict]:
    """What the models say of each face, best score first.

    ``detect``: image to rows (score, box, 5 points); ``embed``: aligned face to a vector; ``mesh``: input to a flat
    output; ``eye``: input to a (1, 6, anchors) output. A face that can't be aligned or embedded is left out; one
    without a mesh has an empty one, and an eye that can't be judged is open.
    """

    def told(f, otherwise):
        try:
            return f()
        except Exception:  # noqa: BLE001  a model may raise anything
            return otherwise

    out, rows = [], detect(rgb)
    for row in rows[kept_boxes(rows[:, 1:5], rows[:, 0], overlap)] if len(rows) else []:
        box, points = row[1:5], row[5:15].reshape(5, 2)
        vector = told(lambda p=points: np.asarray(embed(I.warped(rgb, I.similarity_fit(p, ALIGNED), 112)), np.float64).reshape(-1), None)
        if vector is None:
            continue
        norm = float(np.linalg.norm(vector))
        found = told(lambda b=box: mesh_points(mesh(mesh_input(face_crop(rgb, b)))).tolist(), [])
        closed = [told(lambda p=p, b=box: closed_score(eye(eye_input(eye_crop(rgb, p, b, eye_share)))), 0.0) for p in points[:2]]
        out.append({"score": float(row[0]), "box": box.tolist(), "embedding": (vector / norm if norm > np.finfo(np.float32).eps else vector).tolist(), "mesh": found, "left_closed": closed[0], "right_closed": closed[1]})
    return out
