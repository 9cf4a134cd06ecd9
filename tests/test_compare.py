"""Resampling, differences, crops and panels against plain double loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import compare

IMAGE = "array<array<int>>"


def plain_resized(image, height, width):
    """Pixel by pixel; first along the rows, then along the columns."""

    def sinc(x):
        return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)

    def along(values, out):
        n, result = len(values), []
        if n == out:
            return values
        scale = n / out
        wide = max(scale, 1.0)
        for o in range(out):
            centre = (o + 0.5) * scale
            places = range(max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5)))
            ws = [sinc(t) * sinc(t / 3) if -3 <= t < 3 else 0.0 for t in ((x - centre + 0.5) / wide for x in places)]
            total = sum(ws)
            whole = [int(w / total * 4194304 + (-0.5 if w < 0 else 0.5)) for w in ws]
            result.append(min(255, max(0, (sum(values[x] * k for x, k in zip(places, whole, strict=True)) + 2097152) >> 22)))
        return result

    rows = [along(list(r), width) for r in image]
    return [list(r) for r in zip(*[along(list(c), height) for c in zip(*rows, strict=True)], strict=True)]


@pytest.mark.parametrize(("h", "w"), [(5, 7), (12, 9), (1, 1), (12, 20), (30, 3), (24, 18)])
def test_resized(h, w):
    r = random.Random(h * w)
    image = [[r.choice([0, 255, r.randint(0, 255)]) for _ in range(9)] for _ in range(12)]
    assert compare.resized(np.array(image), h, w).tolist() == plain_resized(image, h, w)


def test_even_images_stay_even():
    assert (compare.resized(np.full((17, 13), 200), 5, 40) == 200).all()


def test_difference(spark):
    r = random.Random(1)
    made = lambda h, w: [[r.randint(0, 255) for _ in range(w)] for _ in range(h)]
    pairs = [(made(6, 8), made(9, 5)), (made(4, 4), made(4, 4)), (same := made(3, 3), same), (made(2, 2), None), ([], made(2, 2)), ([[1, 2], [3]], made(2, 2)), ([[7]], made(3, 3))]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"k int, a {IMAGE}, b {IMAGE}")
    got = {x.k: x.d for x in rows.select("k", compare.difference("a", "b").alias("d")).collect()}
    for k in (0, 1, 2, 6):
        a, b = pairs[k]
        h, w = min(len(a), len(b)), min(len(a[0]), len(b[0]))
        want = [[abs(x - y) for x, y in zip(p, q, strict=True)] for p, q in zip(plain_resized(a, h, w), plain_resized(b, h, w), strict=True)]
        flat = [v for row in want for v in row]
        assert (got[k].height, got[k].width, got[k].diff, got[k].most) == (h, w, want, max(flat)) and got[k].mean == pytest.approx(sum(flat) / len(flat))
        assert got[k].enhanced == [[int(v / max(flat) * 255) if max(flat) else v for v in row] for row in want]
    assert all(got[k].diff is None and got[k].height is None for k in (3, 4, 5))


def test_panels(spark):
    a, b = [[0, 100, 255]], [[10, 100], [0, 30]]
    x = spark.createDataFrame([(a, b), (None, b)], f"a {IMAGE}, b {IMAGE}").select(compare.panels("a", "b").alias("p")).collect()
    red, green = np.array(x[0].p.red), np.array(x[0].p.green)
    assert red.shape == (42, 26) and (red[:40] == 255).all() and x[0].p.green == x[0].p.blue and x[1].p.red is None
    assert red[40].tolist() == [0, 100] + [200] * 10 + [30, 0] + [200] * 10 + [10, 100]
    assert green[41].tolist() == [255, 255] + [200] * 10 + [0, 0] + [200] * 10 + [0, 30]


def test_crops(spark):
    image = [[10 * y + x for x in range(10)] for y in range(10)]
    boxes = [(0.2, 0.3, 0.4, 0.5), (0.0, 0.0, 1.0, 1.0), (0.25, 0.25, 0.25, 0.25), (-3.0, 0.5, 0.04, 9.0), (2.0, 0.0, 3.0, 1.0), (0.5, 0.5, 0.1, 0.1), (None, 0.0, 1.0, 1.0)]
    rows = spark.createDataFrame([(k, image, *b) for k, b in enumerate(boxes)] + [(9, None, *boxes[0]), (10, [], *boxes[0])], f"k int, image {IMAGE}, x0 double, y0 double, x1 double, y1 double")
    got = {x.k: x.c for x in rows.select("k", compare.crop(F.col("image"), *map(F.col, ("x0", "y0", "x1", "y1"))).alias("c")).collect()}
    part = lambda x, y: [[10 * b + a for a in x] for b in y]
    assert got[0] == part(range(1, 5), range(2, 6)) and got[1] == image and got[2] == part([2], [2]) and got[3] == part([0], range(4, 10))
    assert all(not got[k] for k in (4, 5, 6, 9, 10))


def test_mean_grey(spark):
    assert [x[0] for x in spark.createDataFrame([(255, 255, 255), (1, 1, 3), (0, 0, 2)], "r int, g int, b int").select(compare.mean_grey(*map(F.col, "rgb"))).collect()] == [255, 1, 0]
