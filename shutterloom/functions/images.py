"""Pixels with numpy: decoding, resizing, perceptual hash, sharpness, alignment, model inputs."""

from __future__ import annotations

import struct
import zlib

import numpy as np

LUMA = np.array([0.299, 0.587, 0.114])


class UnreadableImage(ValueError):
    """A format that can't be decoded here, or broken bytes."""


def decode(raw: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of a PNG, BMP (24 or 32 bits) or PPM/PGM."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] == b"BM":
            return _bmp(raw)
        if raw[:2] in (b"P5", b"P6"):
            return _pnm(raw)
    except UnreadableImage:
        raise
    except Exception as e:
        raise UnreadableImage(str(e)) from e
    raise UnreadableImage("no decoder for this format")


def from_image_row(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB pixels of a row of Spark's image source, whose channels stand in the order B, G, R, A."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return pixels[:, :, 2::-1] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, 2)


#: The passes of interlaced PNG, as first column, first row, and steps.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(data: bytes, height: int, stride: int, back: int) -> np.ndarray:
    """Rows of bytes of one pass; ``back`` is the distance to the byte that a filter takes as the one before."""
    rows = np.frombuffer(data, np.uint8).reshape(height, 1 + stride)
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.int64)
    for y in range(height):
        filtered, line, kind = rows[y, 1:].astype(np.int64), np.zeros(stride, np.int64), rows[y, 0]
        if kind == 0:
            line = filtered
        elif kind == 1:
            padded = np.concatenate([filtered, np.zeros(-stride % back, np.int64)])
            line = np.cumsum(padded.reshape(-1, back), 0).reshape(-1)[:stride] & 255
        elif kind == 2:
            line = (filtered + above) & 255
        elif kind in (3, 4):
            for x in range(stride):
                a = line[x - back] if x >= back else 0
                b = above[x]
                if kind == 3:
                    line[x] = (filtered[x] + (a + b) // 2) & 255
                else:
                    c = above[x - back] if x >= back else 0
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    line[x] = (filtered[x] + near) & 255
        else:
            raise UnreadableImage("unknown PNG filter")
        out[y], above = line, line
    return out


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(height, width, channels) of rows of bytes with so many bits a sample; 16 bits give their upper byte."""
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1)[:, : rows.shape[1] * 8 // depth * depth].reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * channels].reshape(len(rows), width, channels)


def png_kind(raw: bytes) -> tuple[int, int]:
    """(bits a sample, colour type) of a PNG's head."""
    return (raw[24], raw[25]) if len(raw) > 25 else (0, 0)


def _png(raw: bytes) -> np.ndarray:
    at, data, palette = 8, [], None
    width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", raw[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth not in (1, 2, 4, 8, 16) or interlace > 1 or channels is None:
        raise UnreadableImage("no such PNG")
    while at + 8 <= len(raw):
        n, name = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if name == b"IDAT":
            data.append(body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        at += 12 + n
    whole, at = zlib.decompress(b"".join(data)), 0
    pixels = np.zeros((height, width, channels), np.uint8)
    for x0, y0, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = -(-w * channels * depth // 8)
        rows = _unfiltered(whole[at : at + h * (1 + stride)], h, stride, max(1, channels * depth // 8))
        pixels[y0::dy, x0::dx] = _samples(rows, w, channels, depth)
        at += h * (1 + stride)
    if kind == 3:
        return palette[pixels[:, :, 0]]
    if depth < 8:
        pixels = (pixels.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return np.repeat(pixels[:, :, :1], 3, 2) if channels < 3 else pixels[:, :, :3]


def _bmp(raw: bytes) -> np.ndarray:
    start, = struct.unpack("<I", raw[10:14])
    width, height, _, bits = struct.unpack("<iiHH", raw[18:30])
    if bits not in (24, 32):
        raise UnreadableImage("only 24 and 32-bit BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, abs(height) * stride, start).reshape(abs(height), stride)[:, : width * bits // 8]
    pixels = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def _pnm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    width, height, _ = fields
    channels = 3 if raw[:2] == b"P6" else 1
    pixels = np.frombuffer(raw, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
    return np.repeat(pixels, 3, 2) if channels == 1 else pixels


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ LUMA


def _weights(n: int, m: int) -> np.ndarray:
    """Triangle filter from n samples to m; its support grows with the reduction."""
    scale = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(n)[None] - centre[:, None]) / scale)
    return w / w.sum(1, keepdims=True)


def resized(values: np.ndarray, height: int, width: int) -> np.ndarray:
    rows, columns = _weights(values.shape[0], height), _weights(values.shape[1], width)
    return np.einsum("ab,bc...,dc->ad...", rows, values.astype(np.float64), columns)


def dct(block: np.ndarray) -> np.ndarray:
    """Unnormalised DCT-II in both directions."""
    n = block.shape[0]
    c = np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(n)[:, None] / (2 * n))
    return c @ block @ c.T


def phash(rgb: np.ndarray) -> int:
    """64-bit perceptual hash, as a signed integer."""
    block = dct(resized(grey(rgb), 32, 32))[:8, :8].reshape(-1).astype(np.float32)
    median = np.sort(block[1:])[31]
    if abs(median) < np.finfo(np.float32).eps:
        return 0
    return int(np.packbits(block >= median, bitorder="little").view(np.int64)[0])


def laplacian_variance(values: np.ndarray) -> float:
    """Variance of the 3 by 3 Laplacian. Before the first row and column stands the last one; after the
    last, the last one again."""
    north, west = np.roll(values, 1, 0), np.roll(values, 1, 1)
    south = np.concatenate([values[1:], values[-1:]])
    east = np.concatenate([values[:, 1:], values[:, -1:]], 1)
    edge = north + south + west + east - 4 * values
    return max(0.0, float((edge * edge).mean() - edge.mean() ** 2)) if values.size else 0.0


def similarity_fit(source: np.ndarray, target: np.ndarray) -> tuple[float, float, float, float]:
    """(a, b, tx, ty) of the best x' = a x - b y + tx, y' = b x + a y + ty."""
    x, y = source[:, 0], source[:, 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.stack([x, -y, one, zero], 1), np.stack([y, x, zero, one], 1)])
    normal = rows.T @ rows
    if abs(np.linalg.det(normal)) < 1e-9:
        raise ValueError("the points don't fix a similarity")
    return tuple(np.linalg.solve(normal, rows.T @ np.concatenate([target[:, 0], target[:, 1]])))


def warped(rgb: np.ndarray, fit: tuple[float, float, float, float], size: int) -> np.ndarray:
    """Square image under the inverse of the fit: bilinear, black outside."""
    a, b, tx, ty = fit
    v, u = np.mgrid[:size, :size].astype(np.float64)
    d = a * a + b * b
    x, y = (a * (u - tx) + b * (v - ty)) / d, (-b * (u - tx) + a * (v - ty)) / d
    h, w = rgb.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x0, y0 = np.clip(x0, 0, w - 1), np.clip(y0, 0, h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    p = rgb.astype(np.float64)
    out = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    return np.where(inside[..., None], np.round(out), 0).astype(np.uint8)


def letterboxed(rgb: np.ndarray, size: int, pad: float, mean: float, scale: float, enlarge: bool) -> tuple[np.ndarray, float]:
    """(1, 3, size, size) input of a detector, and the factor that the image was resized by."""
    h, w = rgb.shape[:2]
    factor = size / max(h, w)
    factor = factor if enlarge else min(factor, 1.0)
    small = resized(rgb, max(1, round(h * factor)), max(1, round(w * factor)))
    canvas = np.full((size, size, 3), pad)
    canvas[: small.shape[0], : small.shape[1]] = small
    return ((canvas - mean) / scale).transpose(2, 0, 1)[None].astype(np.float32), factor


def text_input(rgb: np.ndarray, most: int = 736) -> np.ndarray:
    """(1, 3, h, w) input of a text detector: sides multiples of 32, ImageNet mean and deviation."""
    h, w = rgb.shape[:2]
    factor = min(1.0, most / max(h, w))
    side = lambda n: max(32, int(n * factor) // 32 * 32)
    x = resized(rgb, side(h), side(w)) / 255
    return ((x - [0.485, 0.456, 0.406]) / [0.229, 0.224, 0.225]).transpose(2, 0, 1)[None].astype(np.float32)


def anchors_decoded(scores: dict[int, np.ndarray], boxes: dict[int, np.ndarray], points: dict[int, np.ndarray], size: int, least: float, factor: float = 1.0) -> np.ndarray:
    """Rows (score, x1, y1, x2, y2, 5 points) above the score, from outputs at strides 8, 16 and 32 with
    two anchors a place; NaN scores are dropped."""
    out = []
    for stride in scores:
        side = size // stride
        y, x = np.mgrid[:side, :side]
        centre = np.repeat(np.stack([x, y], -1).reshape(-1, 2), 2, 0) * stride
        s, d, k = scores[stride].reshape(-1), boxes[stride].reshape(-1, 4) * stride, points[stride].reshape(-1, 10) * stride
        with np.errstate(invalid="ignore"):
            ok = np.flatnonzero(s >= least)
        box = np.concatenate([centre[ok] - d[ok, :2], centre[ok] + d[ok, 2:]], 1)
        marks = (k[ok].reshape(-1, 5, 2) + centre[ok][:, None]).reshape(-1, 10)
        out.append(np.concatenate([s[ok, None], np.concatenate([box, marks], 1) / factor], 1))
    return np.concatenate(out) if out else np.zeros((0, 15))
