"""Boxes and units as Column expressions. A Box has four columns: x0, y0, x1, y1, top-left origin."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def centre(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def overlap(a: Box, b: Box) -> Column:
    wide = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    high = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without overlap or union."""
    both = overlap(a, b)
    union = a.area + b.area - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def clamped_iou(a: Box, b: Box) -> Column:
    """Intersection over union with areas of inverted boxes taken as 0."""
    both, zero = overlap(a, b), F.lit(0.0)
    area = lambda x: F.greatest(x.width, zero) * F.greatest(x.height, zero)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the area of b, taken as 1 at least."""
    return overlap(a, b) / F.greatest(F.lit(1.0), b.area)


def contains_point(a: Box, x: Column, y: Column) -> Column:
    return x.between(a.x0, a.x1) & y.between(a.y0, a.y1)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def coco_to_centre(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> tuple[Column, Column, Column, Column]:
    """Pixel corner and size to the normalised centre and size."""
    return (x + w / 2) / page_w, (y + h / 2) / page_h, w / page_w, h / page_h


def box_to_coco(a: Box, page_w: Column, page_h: Column) -> tuple[Column, Column, Column, Column]:
    """Normalised corners to pixel corner and size."""
    return a.x0 * page_w, a.y0 * page_h, a.width * page_w, a.height * page_h


def box_to_centre(a: Box) -> tuple[Column, Column, Column, Column]:
    return (*a.centre, a.width, a.height)


def thousandths(bbox: Column) -> Box:
    """[ymin, xmin, ymax, xmax] in thousandths to a normalised box; arrays without a value above 1 are normalised already."""
    scale = F.when(F.exists(bbox, lambda v: v > 1), 1000.0).otherwise(1.0)
    ymin, xmin, ymax, xmax = (bbox[k] / scale for k in range(4))
    return Box(xmin, ymin, xmax, ymax)


def to_pixels(a: Box, page_w: Column, page_h: Column) -> Box:
    """Rounded half to even and kept on the page."""
    at = lambda v, size: F.least(F.greatest(F.bround(v * size, 0), F.lit(0.0)), size).cast("int")
    return Box(at(a.x0, page_w), at(a.y0, page_h), at(a.x1, page_w), at(a.y1, page_h))


def yolo_line(class_id: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """A label line; null for boxes that lie wholly off the page, tested before values are clamped."""
    off = (cx + w / 2 <= 0) | (cx - w / 2 >= 1) | (cy + h / 2 <= 0) | (cy - h / 2 >= 1)
    parts = [clamp(cx), clamp(cy), clamp(w, 0.001), clamp(h, 0.001)]
    return F.when(~off, F.concat_ws(" ", class_id.cast("string"), *[F.format_string("%.6f", p) for p in parts]))


def padded(a: Box, share: float, most: float) -> Box:
    """Grown on each side by a share of its size, by `most` at most, and kept on the page."""
    dx, dy = F.least(a.width * share, F.lit(most)), F.least(a.height * share, F.lit(most))
    return Box(clamp(a.x0 - dx), clamp(a.y0 - dy), clamp(a.x1 + dx), clamp(a.y1 + dy))


def zoomed(a: Box, factor: Column, dx: Column, dy: Column) -> Box:
    """Box after the page is zoomed by a factor about an offset."""
    return Box(*(v * factor + d for v, d in zip(a, (dx, dy, dx, dy), strict=True)))


def cropped(a: Box, window: Box) -> Box:
    """Box in the frame of a crop window, kept inside."""
    return Box(clamp((a.x0 - window.x0) / window.width), clamp((a.y0 - window.y0) / window.height), clamp((a.x1 - window.x0) / window.width), clamp((a.y1 - window.y0) / window.height))


def emu_to_inches(v: Column) -> Column:
    return v / 914400


def twips_to_inches(v: Column) -> Column:
    return v / 1440


def twips_to_points(v: Column) -> Column:
    return v / 20


def half_points(v: Column) -> Column:
    return v / 2


def line_spacing_bucket(ratio: Column) -> Column:
    """Measured line distance over font size to a nominal spacing."""
    out = F.when(ratio < 1.05, 1.0)
    for limit, nominal in ((1.25, 1.15), (1.4, 1.25), (1.6, 1.5), (2.2, 2.0)):
        out = out.when(ratio < limit, nominal)
    return out.otherwise(ratio)


def mad_similarity(a: Column, b: Column) -> Column:
    """1 - mean absolute difference / 255 of two pixel arrays, 0 at least."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, d: s + d)
    return F.greatest(F.lit(0.0), 1 - total / F.size(a) / 255)
