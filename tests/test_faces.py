"""The numbers between the models, on made-up tensors, and providers of candidates."""

import os

import numpy as np
import pytest
from test_flows import JPEG, png, put

from shutterloom import config
from shutterloom.functions import faces, images
from shutterloom.operators.models import FakeFaceAnalyzer
from shutterloom.plans import flows

NAN, INF = float("nan"), float("inf")


def test_crops_are_cut_at_the_edges():
    rgb = np.arange(20 * 30 * 3).reshape(20, 30, 3).astype(np.uint8)
    assert [faces.pixel(v, 9) for v in (NAN, -1, 0.9, 8.99, 9, 1e9, INF, -INF)] == [0, 0, 0, 8, 9, 9, 9, 0]
    assert (faces.face_crop(rgb, np.array([2.5, 1.4, 7.5, 4.6])) == rgb[1:5, 3:8]).all()
    assert (faces.face_crop(rgb, np.array([-5, -5, 99, INF])) == rgb).all()
    for box in ([5, 5, 5, 9], [9, 9, 2, 2], [NAN] * 4, [40, 2, 50, 9]):
        assert (faces.face_crop(rgb, np.array(box)) == np.zeros((1, 1, 3))).all()
    assert (faces.eye_crop(rgb, np.array([10.0, 8.0]), np.array([0, 0, 0, 20.0]), 0.2) == rgb[4:12, 6:14]).all()
    assert (faces.eye_crop(rgb, np.array([0.0, 0.0]), np.array([0, 0, 0, -3.0]), 2.0) == rgb[:2, :2]).all()
    assert faces.eye_crop(rgb, np.array([10.0, 8.0]), np.array([0, 0, 0, 1.0]), 0.2).shape == (1, 1, 3)


def test_inputs_and_outputs():
    eye = faces.eye_input(np.full((40, 80, 3), 255, np.uint8))
    assert eye.shape == (1, 3, 640, 640) and (eye[0, :, 160:480] == 1).all() and np.allclose(eye[0, :, :160], 114 / 255) and np.allclose(eye[0, :, 480:], 114 / 255)
    assert faces.eye_input(np.zeros((1, 1, 3), np.uint8)).max() == 0
    mesh = faces.mesh_input(np.full((7, 300, 3), 51, np.uint8))
    assert mesh.shape == (1, 3, 192, 192) and np.allclose(mesh, 0.2)
    scores = np.full((1, 6, 5), 0.9, np.float32)
    scores[0, 5] = [0.1, NAN, 0.4, -3, 0.2]
    assert faces.closed_score(scores) == np.float32(0.4) and faces.closed_score(scores * 9) == 1.0 and faces.closed_score(-np.ones((1, 6, 2))) == 0.0
    for shape in ((1, 5, 9), (2, 6, 9), (6, 9), (1, 6, 0)):
        with pytest.raises(ValueError):
            faces.closed_score(np.zeros(shape))
    points = faces.mesh_points(np.arange(1500.0).reshape(1, 1500))
    assert points.shape == (468, 3) and points[1].tolist() == [3, 4, 5] and points[467].tolist() == [1401, 1402, 1403]
    with pytest.raises(ValueError):
        faces.mesh_points(np.zeros(1403))


def test_suppression_equals_the_plain_loop():
    rng = np.random.default_rng(6)

    def share(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = max(0, a[2] - a[0]) * max(0, a[3] - a[1]) + max(0, b[2] - b[0]) * max(0, b[3] - b[1]) - w * h
        return w * h / union if union > 0 else 0

    for n in (0, 1, 60, 300):
        at = rng.integers(0, 30, (n, 2))
        boxes, scores = np.hstack([at, at + rng.integers(0, 12, (n, 2))]), rng.integers(0, 9, n) / 9
        want = []
        for i in sorted(range(n), key=lambda i: (-scores[i], i)):
            if all(share(boxes[i], boxes[k]) <= 0.4 for k in want):
                want.append(i)
        assert faces.kept_boxes(boxes, scores, 0.4).tolist() == want


def test_chain_of_models():
    rgb = np.random.default_rng(1).integers(0, 255, (200, 200, 3)).astype(np.uint8)
    points = (faces.ALIGNED + 40).reshape(-1)
    row = lambda score, shift=0.0, marks=points: np.concatenate([[score, 50 + shift, 50, 150 + shift, 150], marks])
    rows = np.stack([row(0.6, 5), row(0.9), row(0.8, 90), row(0.7, -90, np.ones(10))])
    closed = np.zeros((1, 6, 3))
    closed[0, 5] = 0.8
    seen = []

    def eye(x):
        seen.append(x.shape)
        if len(seen) == 4:
            raise RuntimeError("no model")
        return closed * (len(seen) == 1)

    def mesh(x):
        if len(seen) == 2:
            raise OSError("no mesh")
        return np.ones((1, 1404))

    found = faces.analyzed(rgb, lambda _: rows, lambda face: np.array([3.0, 4.0, face.shape[0] * 0]), mesh, eye)
    # the overlapping box goes, the one whose points fix no similarity is left out
    assert [f["score"] for f in found] == [0.9, 0.8] and found[0]["embedding"] == [0.6, 0.8, 0.0]
    assert (len(found[0]["mesh"]), found[1]["mesh"]) == (468, []) and [(f["left_closed"], f["right_closed"]) for f in found] == [(pytest.approx(0.8), 0.0), (0.0, 0.0)]
    assert faces.analyzed(rgb, lambda _: np.zeros((0, 15)), None, None, None) == []


def test_blinks_and_smiles_follow_from_eyes_and_mesh(spark, tmp_path):
    src = f"{tmp_path}/in"
    rgb = images.resized(np.random.default_rng(1).integers(0, 255, (8, 8, 3)), 64, 64)
    for name in "abc":
        put(f"{src}/{name}.png", png(np.clip(rgb, 0, 255).astype(np.uint8)))
    open_eyes = {"left_closed": 0.1, "right_closed": 0.2, "mesh": None}
    found = {f"{src}/a.png": [open_eyes], f"{src}/b.png": [open_eyes], f"{src}/c.png": [{"left_closed": 0.1, "right_closed": 0.9, "mesh": []}]}
    report, _ = flows.cull(spark, [src], f"{tmp_path}/out", FakeFaceAnalyzer(found), config.Config(face=config.Face(sharpness_min=1.0)))
    # c would win the tie as the last one, were its eye not closed
    assert report.counts["failed"] == 0 and os.path.exists(f"{tmp_path}/out/group-001/BEST_b.png")


def test_providers_add_candidates(spark, tmp_path):
    src = f"{tmp_path}/in"
    put(f"{src}/a.jpg", JPEG + b"a"), put(f"{src}/b.jpg", JPEG + b"bb")

    def diary(path, size, modified):
        if path.endswith("a.jpg"):
            yield "Diary", 1_104_580_800 + size * 0  # 2005-01-01, with the rank of a sidecar
            yield "Unknown", None

    def exif(path, size, modified):
        if size == len(JPEG) + 2:
            yield "ExifDateTimeOriginal", 1_046_520_000  # 2003-03-01

    _, done = flows.copy(spark, [src], f"{tmp_path}/out", providers=(diary, exif))
    assert sorted(os.path.relpath(r.target, f"{tmp_path}/out") for r in done.collect()) == ["2003/03/b.jpg", "2005/01/a.jpg"]
