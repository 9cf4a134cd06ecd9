"""Grey images as arrays of rows: similarity, drift and blankness. Pixels come as data; nothing here renders a page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIMILARITY = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("method", T.StringType())])
DRIFT = T.StructType([T.StructField(n, t) for n, t in (("aligned_score", T.DoubleType()), ("drift_x", T.IntegerType()), ("drift_y", T.IntegerType()), ("search_pad_px", T.IntegerType()), ("hit_boundary", T.BooleanType()))])


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return F.least(F.greatest(0.299 * red + 0.587 * green + 0.114 * blue, F.lit(0)), F.lit(255)).cast("int")


def window_size(h: int, w: int, most: int = 7) -> int | None:
    """The side of the comparison window: odd, at most `most`; None for images below 7 pixels."""
    side = min(h, w, most)
    side -= side % 2 == 0
    return side if side >= 7 else None


def box_means(x: np.ndarray, n: int) -> np.ndarray:
    """Means of all n by n windows, by sums of sums."""
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    s[1:, 1:] = x.cumsum(0).cumsum(1)
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def structural(a: np.ndarray, b: np.ndarray, n: int) -> float:
    """Mean structural similarity of two grey images by uniform windows of n by n, with sample covariance."""
    a, b = a.astype(float), b.astype(float)
    ma, mb = box_means(a, n), box_means(b, n)
    k = n * n / (n * n - 1)
    va, vb, cov = k * (box_means(a * a, n) - ma**2), k * (box_means(b * b, n) - mb**2), k * (box_means(a * b, n) - ma * mb)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def similarity_of(a: np.ndarray, b: np.ndarray) -> tuple[float, str]:
    n = window_size(*a.shape) if a.ndim == 2 and a.size else None
    if n:
        return structural(a, b, n), "ssim"
    return max(0.0, 1 - float(np.abs(a.astype(float) - b.astype(float)).mean()) / 255) if a.size else 0.0, "mad"


def _image(rows) -> np.ndarray:
    return np.array([list(r) for r in rows], np.float64) if rows is not None and len(rows) else np.zeros((0, 0))


@F.pandas_udf(SIMILARITY)
def similarity(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Structural similarity of equally large images, for small ones by mean absolute difference."""
    out = []
    for a, b in zip(map(_image, left), map(_image, right), strict=True):
        h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
        out.append(similarity_of(a[:h, :w], b[:h, :w]))
    return pd.DataFrame(out, columns=["score", "method"])


def best_shift(ref: np.ndarray, page: np.ndarray, x: int, y: int, pad: int) -> tuple[float, int, int, bool]:
    """Where a region fits best on a page within `pad` pixels of (x, y): in steps of 8, then of 1 about the best. Drift is
    measured from the region's own place, also where the page's edge cuts the search window."""
    h, w = ref.shape
    x0, y0, x1, y1 = max(0, x - pad), max(0, y - pad), min(page.shape[1], x + w + pad), min(page.shape[0], y + h + pad)
    best = (-1.0, 0, 0)

    def look(rows, columns):
        nonlocal best
        for dy in rows:
            for dx in columns:
                score = similarity_of(ref, page[y0 + dy : y0 + dy + h, x0 + dx : x0 + dx + w])[0]
                if score > best[0]:
                    best = (score, dx, dy)

    most_y, most_x = y1 - y0 - h + 1, x1 - x0 - w + 1
    if most_x <= 0 or most_y <= 0:
        return 0.0, 0, 0, False
    look(range(0, most_y, 8), range(0, most_x, 8))
    _, cx, cy = best
    look(range(max(0, cy - 4), min(most_y, cy + 5)), range(max(0, cx - 4), min(most_x, cx + 5)))
    drift_x, drift_y = x0 + best[1] - x, y0 + best[2] - y
    return best[0], drift_x, drift_y, max(abs(drift_x), abs(drift_y)) >= pad - 2


@F.pandas_udf(DRIFT)
def drift(ref: pd.Series, page: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    out = []
    for r, p, at_x, at_y in zip(map(_image, ref), map(_image, page), x, y, strict=True):
        pad = max(64, int(0.05 * min(r.shape)))
        score, dx, dy, hit = best_shift(r, p, int(at_x), int(at_y), pad)
        out.append((score, dx, dy, pad, hit))
    return pd.DataFrame(out, columns=DRIFT.names)


def is_blank(pixels: Column) -> Column:
    """Whether an array of grey values is nearly white and even; true if empty."""
    n, zero = F.size(pixels), F.lit(0.0)
    mean = F.aggregate(pixels, zero, lambda s, v: s + v, lambda s: s / n)
    square = F.aggregate(pixels, zero, lambda s, v: s + v.cast("double") * v, lambda s: s / n)
    return F.when(n == 0, True).otherwise((mean >= 250) & (square - mean * mean <= 4))


def is_empty_page(mean: Column, has_text: Column) -> Column:
    return (mean > 254.5) | ((mean > 250) & ~has_text)


def content_top(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each page with a pixel below 250; rows: y and darkest."""
    return rows.where("darkest < 250").groupBy(*by).agg(F.min("y").alias("content_top"))


def overlay_verdict(pixels: DataFrame, by: list[str]) -> DataFrame:
    """What an overlay of two pages shows: red pixels are the reference's alone, cyan ones the generated page's."""
    red = (F.col("r") > 200) & (F.col("g") < 100) & (F.col("b") < 100)
    cyan = (F.col("r") < 100) & (F.col("g") > 200) & (F.col("b") > 200)
    counts = pixels.groupBy(*by).agg(F.count_if(red).alias("ref_only"), F.count_if(cyan).alias("gen_only"))
    verdict = F.when((F.col("ref_only") > 1000) & (F.col("gen_only") < 100), "MISSING_IN_GEN").when((F.col("ref_only") > 1000) & (F.col("gen_only") > 1000), "MOVED").otherwise("MATCH")
    return counts.withColumn("verdict", verdict)
