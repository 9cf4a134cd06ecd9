"""Comparing grey images of different size: resampling to a common size, difference maps, crops, and panels for a reader.

Images are arrays of rows of values from 0 to 255. Crops and grey values are Column expressions; resampling needs sums over windows that Spark's array functions
don't have, so it runs on Arrow batches, image by image. Null images, and rows of different length, give null.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = T.ArrayType(T.ArrayType(T.IntegerType()))
DIFFERENCE = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("diff", ROWS), T.StructField("enhanced", ROWS), T.StructField("mean", T.DoubleType()), T.StructField("most", T.IntegerType())])
PANELS = T.StructType([T.StructField(c, ROWS) for c in ("red", "green", "blue")])
#: Lobes of the Lanczos kernel, bits of its weights, and of a panel's picture the factor of its differences, its gap and its header.
LOBES, BITS = 3, 22
FACTOR, GAP, GAP_GREY, HEADER = 3, 10, 200, 40


def mean_grey(red: Column, green: Column, blue: Column) -> Column:
    """The mean of three channels, without its fraction."""
    return F.floor((red + green + blue) / 3).cast("int")


@lru_cache(maxsize=256)
def weights(size: int, out: int) -> np.ndarray:
    """Matrix (out, size) of whole weights with BITS bits behind the point. Each row is a kernel around the place of an output pixel, stretched where
    the image shrinks, and its weights sum up to 1 before they are rounded."""
    scale = size / out
    wide = max(scale, 1.0)
    matrix = np.zeros((out, size), np.int64)
    for o in range(out):
        centre = (o + 0.5) * scale
        first, end = max(0, int(centre - LOBES * wide + 0.5)), min(size, int(centre + LOBES * wide + 0.5))
        t = (np.arange(first, end) - centre + 0.5) * (1.0 / wide)
        w = np.where((t >= -LOBES) & (t < LOBES), np.sinc(t) * np.sinc(t / LOBES), 0.0)
        w = w / w.sum()
        matrix[o, first:end] = np.trunc(w * (1 << BITS) + np.where(w < 0, -0.5, 0.5))
    return matrix


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image in another size: rows first, then columns, each rounded to whole values from 0 to 255. An axis that keeps its size is left
    as it is."""
    image = image.astype(np.int64)
    if image.shape[1] != width:
        image = np.clip((image @ weights(image.shape[1], width).T + (1 << BITS - 1)) >> BITS, 0, 255)
    if image.shape[0] != height:
        image = np.clip((weights(image.shape[0], height) @ image + (1 << BITS - 1)) >> BITS, 0, 255)
    return image


def image_of(rows) -> np.ndarray | None:
    """An array of an image's values; None for null, empty and ragged ones."""
    if rows is None or not len(rows) or any(r is None or len(r) != len(rows[0]) for r in rows) or not len(rows[0]):
        return None
    return np.array([list(r) for r in rows], np.int64)


def _pairs(left: pd.Series, right: pd.Series):
    for a, b in zip(map(image_of, left), map(image_of, right), strict=True):
        yield None if a is None or b is None else (a, b)


@F.pandas_udf(DIFFERENCE)
def difference(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Both images in the smaller height and width, their absolute difference, the same stretched so that the largest one is 255, its mean and
    its largest value."""
    out = []
    for pair in _pairs(left, right):
        if pair is None:
            out.append((None,) * 6)
            continue
        a, b = pair
        h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
        diff = np.abs(resized(a, h, w) - resized(b, h, w))
        most = int(diff.max())
        out.append((h, w, diff.tolist(), ((diff / most) * 255).astype(np.int64).tolist() if most else diff.tolist(), float(diff.mean()), most))
    return pd.DataFrame(out, columns=DIFFERENCE.names)


@F.pandas_udf(PANELS)
def panels(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Reference, differences and generated image side by side under a blank header, as three channels. The lower one of both is filled up with white,
    the wider one is cut; in the middle what differs is red and what agrees is cyan."""
    out = []
    for pair in _pairs(left, right):
        if pair is None:
            out.append((None,) * 3)
            continue
        h, w = max(x.shape[0] for x in pair), min(x.shape[1] for x in pair)
        a, b = (np.vstack([x[:, :w], np.full((h - x.shape[0], w), 255)]) for x in pair)
        diff = np.minimum(np.abs(a - b) * FACTOR, 255)
        gap = np.full((h, GAP), GAP_GREY)
        sheets = [np.vstack([np.full((HEADER, 3 * w + 2 * GAP), 255), np.hstack([a, gap, middle, gap, b])]) for middle in (diff, 255 - diff, 255 - diff)]
        out.append(tuple(s.tolist() for s in sheets))
    return pd.DataFrame(out, columns=PANELS.names)


def crop(image: Column, x0: Column, y0: Column, x1: Column, y1: Column, pad: float = 0.01) -> Column:
    """The part of an image inside a box in shares of it, `pad` of the image wider on each side, clamped to the image; pixels that the box touches
    count. Null for a box with a null corner, one outside the image, or without extent even with its padding."""
    height, width = F.size(image), F.size(F.try_element_at(image, F.lit(1)))
    low = lambda v, n: F.floor(F.greatest(F.lit(0.0), v - pad) * n).cast("int")
    high = lambda v, n: F.ceil(F.least(F.lit(1.0), v + pad) * n).cast("int")
    left, top, right, bottom = low(x0, width), low(y0, height), high(x1, width), high(y1, height)
    inside = F.transform(F.slice(image, top + 1, F.greatest(bottom - top, F.lit(0))), lambda row: F.slice(row, left + 1, F.greatest(right - left, F.lit(0))))
    told = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    return F.when(told & (right > left) & (bottom > top), inside)
