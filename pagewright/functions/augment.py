"""Augmented page images: tint, aging, shadow, noise, cut-outs, lower resolution and a warp that carries the boxes along.

Images are arrays of rows of pixels of three values from 0 to 255; boxes have a label and corners in shares of the image. What is random follows from a
seed and the row's key by a counter-based generator: each value is a hash of seed, key, purpose and a running number. So a row's result depends on
nothing but the row, whatever the partitioning, and an augmented row can be made again alone. Kernels run on Arrow batches, image by image.
Null, empty and ragged images give null and keep no boxes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "label string, x0 double, y0 double, x1 double, y1 double"
RESULT = f"image array<array<array<int>>>, boxes array<struct<{BOX}>>"
#: Colours of paper, the light from which on a pixel is paper, and how strong each change is.
TINTS = ((255, 255, 250), (252, 252, 255), (250, 250, 250), (255, 253, 248))
AGED, PAPER = (255, 250, 235), 200
TINT_SHARE, AGED_SHARE, HOLE_SHARE = (0.01, 0.04), (0.02, 0.08), (0.02, 0.08)
DARKEST, CORNER_DARKEST, HOLES, NOISE, WARP, DEGRADED = 0.75, 0.85, 2, 0.002, 0.03, 0.5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draws:
    """Random numbers of one row, by purpose."""

    def __init__(self, seed: int, key: int) -> None:
        self.base = _mixed(np.array([key & (2**64 - 1)], np.uint64) + _mixed(np.array([seed & (2**64 - 1)], np.uint64)))

    def uniform(self, purpose: int, n: int, low: float = 0.0, high: float = 1.0) -> np.ndarray:
        """n numbers from low to high."""
        start = _mixed(self.base + np.array([purpose], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bits = _mixed(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        return low + (high - low) * ((bits >> np.uint64(11)) / 2.0**53)

    def whole(self, purpose: int, low: int, high: int) -> int:
        """A whole number from low to high, both included."""
        return low + min(int(self.uniform(purpose, 1)[0] * (high - low + 1)), high - low)


def tint(image: np.ndarray, draw: Draws) -> np.ndarray:
    """Light pixels take on a little of one of the colours of paper."""
    colour, share = np.array(TINTS[draw.whole(1, 0, len(TINTS) - 1)]), draw.uniform(2, 1, *TINT_SHARE)[0]
    return np.where(image.mean(2, keepdims=True) > PAPER, image * (1 - share) + colour * share, image)


def aging(image: np.ndarray, draw: Draws) -> np.ndarray:
    share = draw.uniform(3, 1, *AGED_SHARE)[0]
    return image * (1 - share) + np.array(AGED) * share


def cutout(image: np.ndarray, draw: Draws) -> np.ndarray:
    """White rectangles."""
    h, w = image.shape[:2]
    out = image.copy()
    for k in range(HOLES):
        tall, wide = (draw.whole(10 + 4 * k + j, int(n * HOLE_SHARE[0]), int(n * HOLE_SHARE[1])) for j, n in ((0, h), (1, w)))
        y, x = draw.whole(12 + 4 * k, 0, h - tall), draw.whole(13 + 4 * k, 0, w - wide)
        out[y : y + tall, x : x + wide] = 255
    return out


def noise(image: np.ndarray, draw: Draws) -> np.ndarray:
    """White and black pixels, NOISE of all."""
    u = draw.uniform(4, image.shape[0] * image.shape[1]).reshape(image.shape[:2])
    out = image.copy()
    out[u < NOISE / 2] = 255
    out[(u >= NOISE / 2) & (u < NOISE)] = 0
    return out


def shadow(image: np.ndarray, draw: Draws) -> np.ndarray:
    """Darker towards one side or one corner."""
    h, w = image.shape[:2]
    side = draw.whole(5, 0, 4)
    if side == 4:
        light = np.linspace(CORNER_DARKEST, 1, h)[:, None] * np.linspace(CORNER_DARKEST, 1, w)
    else:
        light = np.linspace(DARKEST, 1, h if side < 2 else w)[:: -1 if side % 2 else 1]
        light = np.broadcast_to(light[:, None] if side < 2 else light, (h, w))
    return image * light[:, :, None]


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float | None) -> np.ndarray:
    """Values at places between pixels, from the four around each; beyond the edge the edge's, or `outside`."""
    h, w = image.shape[:2]
    top, left = np.floor(y).astype(int), np.floor(x).astype(int)
    dy, dx = (y - top)[..., None], (x - left)[..., None]

    def at(row: np.ndarray, column: np.ndarray) -> np.ndarray:
        found = image[np.clip(row, 0, h - 1), np.clip(column, 0, w - 1)]
        if outside is None:
            return found
        return np.where(((row < 0) | (row >= h) | (column < 0) | (column >= w))[..., None], outside, found)

    return (at(top, left) * (1 - dx) + at(top, left + 1) * dx) * (1 - dy) + (at(top + 1, left) * (1 - dx) + at(top + 1, left + 1) * dx) * dy


def degrade(image: np.ndarray, draw: Draws) -> np.ndarray:
    """Down to DEGRADED of its size and back, between pixels in straight lines."""
    h, w = image.shape[:2]

    def scaled(x: np.ndarray, tall: int, wide: int) -> np.ndarray:
        rows, columns = (np.arange(n) + 0.5 for n in (tall, wide))
        return sampled(x, *np.meshgrid(rows * x.shape[0] / tall - 0.5, columns * x.shape[1] / wide - 0.5, indexing="ij"), None)

    return scaled(scaled(image, max(1, int(h * DEGRADED)), max(1, int(w * DEGRADED))), h, w)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 by 3 matrix that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def applied(matrix: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v, w = (matrix[k, 0] * x + matrix[k, 1] * y + matrix[k, 2] for k in range(3))
    return u / w, v / w


def corners(draw: Draws) -> np.ndarray:
    """Where the image's corners go, in shares of it: inwards by up to WARP."""
    inside = draw.uniform(6, 8, 0, WARP).reshape(4, 2)
    return np.array([(0, 0), (1, 0), (1, 1), (0, 1)]) + inside * np.array([(1, 1), (-1, 1), (-1, -1), (1, -1)])


def warp(image: np.ndarray, draw: Draws) -> np.ndarray:
    """As if seen from aside; white around it."""
    h, w = image.shape[:2]
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    back = homography(corners(draw), square)
    rows, columns = np.meshgrid((np.arange(h) + 0.5) / h, (np.arange(w) + 0.5) / w, indexing="ij")
    x, y = applied(back, columns, rows)
    return sampled(image, y * h - 0.5, x * w - 0.5, 255.0)


def warped_boxes(boxes: list[tuple], draw: Draws) -> list[tuple]:
    """The boxes around the warped ones, clamped to the image; those without extent, before or after, are dropped."""
    there = homography(np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float), corners(draw))
    out = []
    for label, x0, y0, x1, y1 in boxes:
        if None in (x0, y0, x1, y1) or x1 <= x0 or y1 <= y0:
            continue
        x, y = applied(there, np.array([x0, x1, x1, x0]), np.array([y0, y0, y1, y1]))
        low_x, low_y, high_x, high_y = (float(np.clip(v, 0, 1)) for v in (x.min(), y.min(), x.max(), y.max()))
        if high_x > low_x and high_y > low_y:
            out.append((label, low_x, low_y, high_x, high_y))
    return out


STEPS: dict[str, Callable[[np.ndarray, Draws], np.ndarray]] = {f.__name__: f for f in (tint, aging, shadow, cutout, noise, degrade, warp)}


def _image(rows) -> np.ndarray | None:
    if rows is None or not len(rows) or any(r is None or len(r) != len(rows[0]) or any(p is None or len(p) != 3 for p in r) for r in rows) or not len(rows[0]):
        return None
    return np.array([[list(p) for p in r] for r in rows], float)


def augmented(pages: DataFrame, steps: tuple[str, ...], key: Column, seed: int = 0, image_col: str = "image", boxes_col: str = "boxes") -> DataFrame:
    """pages with image and boxes after `steps`, one after the other; values are cut to whole numbers from 0 to 255 after each. `key` names the row: rows
    with equal keys get equal draws."""
    if unknown := set(steps) - set(STEPS):
        raise ValueError(f"no such step: {', '.join(sorted(unknown))}")

    @F.pandas_udf(RESULT)
    def run(images: pd.Series, boxes: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for rows, own, k in zip(images, boxes, keys, strict=True):
            image = _image(rows)
            if image is None:
                out.append((None, []))
                continue
            draw = Draws(seed, int(k))
            found = [tuple(b[c] for c in ("label", "x0", "y0", "x1", "y1")) for b in ([] if own is None else own)]
            for step in steps:
                image = np.clip(STEPS[step](image, draw), 0, 255).astype(np.int64).astype(float)
                found = warped_boxes(found, draw) if step == "warp" else found
            out.append((image.astype(int).tolist(), [dict(zip(("label", "x0", "y0", "x1", "y1"), b, strict=True)) for b in found]))
        return pd.DataFrame(out, columns=["image", "boxes"])

    done = pages.withColumn("__done", run(F.col(image_col), F.col(boxes_col), F.xxhash64(key)))
    return done.withColumns({image_col: F.col("__done.image"), boxes_col: F.col("__done.boxes")}).drop("__done")
