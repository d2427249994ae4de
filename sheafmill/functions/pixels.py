"""Pixel kernels in numpy over height x width x 3 byte images; one call works on a whole image."""

from __future__ import annotations

import numpy as np

DET_MEAN, DET_STD = np.float32([0.485, 0.456, 0.406]), np.float32([0.229, 0.224, 0.225])
MFR_MEAN, MFR_STD = np.float32(0.7931), np.float32(0.1738)
LUMA = np.float32([0.114, 0.587, 0.299])


def _bilinear(image: np.ndarray, ys: np.ndarray, xs: np.ndarray, edge: float = 0.0) -> np.ndarray:
    """Samples at fractional places, clamped to the image; a grid if ys and xs are one row each."""
    h, w = image.shape[:2]
    ys, xs = np.clip(ys, 0, np.float32(h - 1 - edge)).astype(np.float32), np.clip(xs, 0, np.float32(w - 1 - edge)).astype(np.float32)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    dy, dx = ys - y0, xs - x0
    if ys.ndim == 1:
        y0, y1, dy, x0, x1, dx = y0[:, None], y1[:, None], dy[:, None], x0[None], x1[None], dx[None]
    if image.ndim == 3:
        dy, dx = dy[..., None], dx[..., None]
    pixels = image.astype(np.float32)
    upper = pixels[y0, x0] + (pixels[y0, x1] - pixels[y0, x0]) * dx
    lower = pixels[y1, x0] + (pixels[y1, x1] - pixels[y1, x0]) * dx
    return upper + (lower - upper) * dy


def _centres(size: int, source: int) -> np.ndarray:
    return (np.arange(size, dtype=np.float32) + np.float32(0.5)) * np.float32(source) / np.float32(size) - np.float32(0.5)


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    return _bilinear(image, _centres(h, image.shape[0]), _centres(w, image.shape[1]))


def det_input(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Detector input, 3 x h x w, normalised by channel."""
    return np.ascontiguousarray(((resize(image, h, w) / np.float32(255) - DET_MEAN) / DET_STD).transpose(2, 0, 1))


def det_batch(images: list[np.ndarray], h: int, w: int) -> np.ndarray:
    return np.stack([det_input(image, h, w) for image in images]) if images else np.zeros((0, 3, h, w), np.float32)


def crop_reversed(page: np.ndarray, x0: int, y0: int, x1: int, y1: int, paste: int = 50) -> np.ndarray:
    """A box of the page with a white margin and its channels reversed; white outside of the page."""
    out = np.full((max(y1 - y0, 0) + 2 * paste, max(x1 - x0, 0) + 2 * paste, 3), 255, np.uint8)
    top, left = max(y0, 0), max(x0, 0)
    inside = page[top : max(y1, 0), left : max(x1, 0), ::-1]
    at_y, at_x = paste + top - y0, paste + left - x0
    out[at_y : at_y + inside.shape[0], at_x : at_x + inside.shape[1]] = inside
    return out


def mask_boxes(image: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The image with all half-open boxes white."""
    out = image.copy()
    for x0, y0, x1, y1 in np.clip(np.asarray(boxes, int).reshape(-1, 4), 0, None):
        out[y0:y1, x0:x1] = 255
    return out


def warp(image: np.ndarray, matrix: np.ndarray, h: int, w: int) -> np.ndarray:
    """Each output pixel's source by a 3 x 3 matrix, edges repeated, truncated to bytes."""
    x, y = np.meshgrid(np.arange(w, dtype=np.float32), np.arange(h, dtype=np.float32))
    sx, sy, sz = np.tensordot(np.asarray(matrix, np.float32).reshape(3, 3), np.stack([x, y, np.ones_like(x)]), 1)
    return np.clip(_bilinear(image, sy / sz, sx / sz), 0, 255).astype(np.uint8)


def line_input(image: np.ndarray, content: int, width: int, height: int = 48) -> np.ndarray:
    """Recogniser input, 3 x height x width: the line `content` wide, zeros to its right."""
    out = np.zeros((3, height, width), np.float32)
    out[:, :, :content] = (resize(image, height, content) / np.float32(127.5) - 1).transpose(2, 0, 1)
    return out


def line_batch(images: list[np.ndarray], contents: list[int], width: int) -> np.ndarray:
    return np.stack([line_input(i, c, width) for i, c in zip(images, contents)]) if images else np.zeros((0, 3, 48, width), np.float32)


def luma(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float32) @ LUMA


def formula_batch(images: list[np.ndarray], side: int = 384) -> np.ndarray:
    """Formula encoder input, n x 1 x side x side: grey, fitted and centred on white, normalised."""
    out = np.full((len(images), 1, side, side), (1 - MFR_MEAN) / MFR_STD, np.float32)
    for k, image in enumerate(images):
        h, w = image.shape[:2]
        ratio = min(np.float32(side) / np.float32(h), np.float32(side) / np.float32(w))
        new_h, new_w = int(h * ratio + np.float32(0.5)), int(w * ratio + np.float32(0.5))
        top, left = (side - new_h) // 2, (side - new_w) // 2
        ys, xs = (np.arange(n, dtype=np.float32) / ratio for n in (new_h, new_w))
        grey = _bilinear(luma(image), ys, xs, 1e-5)
        out[k, 0, top : top + new_h, left : left + new_w] = (grey / np.float32(255) - MFR_MEAN) / MFR_STD
    return out


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four target points to four source points."""
    rows, values = [], []
    for (x, y), (u, v) in zip(target, source):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
        values += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1).reshape(3, 3)


def crop_line(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The pixels of a text line: a slice of an upright quad, else straightened by perspective."""
    quad = np.asarray(quad, np.float32)
    if len(np.unique(quad[:, 0])) == 2 and len(np.unique(quad[:, 1])) == 2:
        (x0, y0), (x1, y1) = quad.min(axis=0).astype(int), quad.max(axis=0).astype(int)
        return image[max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)].copy()
    side = lambda a, b: float(np.linalg.norm(quad[a] - quad[b]))
    w, h = int(max(side(0, 1), side(2, 3))), int(max(side(0, 3), side(1, 2)))
    if w < 1 or h < 1:
        return image[:0, :0]
    return warp(image, perspective(quad, np.array([[0, 0], [w, 0], [w, h], [0, h]])), h, w)


def upright(image: np.ndarray, ratio: float = 1.5) -> np.ndarray:
    """Turned by a quarter, against the clock, if it is much taller than wide."""
    h, w = image.shape[:2]
    return np.rot90(image) if w and h / w >= ratio else image


def decode_row(row) -> np.ndarray:
    """The pixels of a row of Spark's image source, in its channel order."""
    channels = row["nChannels"]
    pixels = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], channels)
    return pixels if channels == 3 else np.repeat(pixels[:, :, :1], 3, axis=2) if channels == 1 else pixels[:, :, :3]
