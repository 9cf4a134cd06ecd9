"""Augmentations: draws that depend on the row alone, kernels against plain loops, boxes that follow the pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import augment

SCHEMA = "id long, image array<array<array<int>>>, boxes array<struct<label string, x0 double, y0 double, x1 double, y1 double>>"


def image_of(seed, h=20, w=30):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3))


def test_draws():
    one = augment.Draws(1, 2).uniform(3, 100_000)
    assert abs(one.mean() - 0.5) < 0.01 and one.min() >= 0 and one.max() < 1 and np.histogram(one, 10)[0].min() > 9500
    assert (one[:10] == augment.Draws(1, 2).uniform(3, 10)).all()
    for other in (augment.Draws(2, 2).uniform(3, 1000), augment.Draws(1, 3).uniform(3, 1000), augment.Draws(1, 2).uniform(4, 1000), augment.Draws(-1, -2).uniform(3, 1000)):
        assert abs(np.corrcoef(one[:1000], other)[0, 1]) < 0.15
    got = [augment.Draws(0, k).whole(1, 3, 6) for k in range(400)]
    assert set(got) == {3, 4, 5, 6}


def test_homography():
    r = np.random.default_rng(0)
    for _ in range(20):
        a, b = (np.array([(0, 0), (1, 0), (1, 1), (0, 1)]) + r.uniform(-0.2, 0.2, (4, 2)) for _ in range(2))
        x, y = augment.applied(augment.homography(a, b), a[:, 0], a[:, 1])
        assert np.allclose(np.c_[x, y], b)
        # straight lines stay straight, and the way back is the inverse
        m = augment.homography(a, b)
        u, v = augment.applied(augment.homography(b, a), *augment.applied(m, np.array([0.3, 0.4]), np.array([0.7, 0.1])))
        assert np.allclose(u, [0.3, 0.4]) and np.allclose(v, [0.7, 0.1])


def plain_warp(image, draw):
    h, w = image.shape[:2]
    back = augment.homography(augment.corners(draw), np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float))
    out = np.zeros(image.shape)
    value = lambda y, x: image[y, x].astype(float) if 0 <= y < h and 0 <= x < w else np.full(3, 255.0)
    for row in range(h):
        for column in range(w):
            px, py = (column + 0.5) / w, (row + 0.5) / h
            d = back[2, 0] * px + back[2, 1] * py + 1
            x = (back[0, 0] * px + back[0, 1] * py + back[0, 2]) / d * w - 0.5
            y = (back[1, 0] * px + back[1, 1] * py + back[1, 2]) / d * h - 0.5
            x0, y0 = int(np.floor(x)), int(np.floor(y))
            fx, fy = x - x0, y - y0
            out[row, column] = (value(y0, x0) * (1 - fx) + value(y0, x0 + 1) * fx) * (1 - fy) + (value(y0 + 1, x0) * (1 - fx) + value(y0 + 1, x0 + 1) * fx) * fy
    return out


def test_warp_by_plain_loops_and_boxes_follow():
    for seed in range(4):
        draw, image = augment.Draws(seed, 5), image_of(seed)
        assert np.allclose(augment.warp(image, draw), plain_warp(image, draw))
    # a black rectangle stays inside its box, and the box is tight
    page = np.full((200, 300, 3), 255)
    page[40:120, 60:210] = 0
    for key in range(6):
        draw = augment.Draws(9, key)
        dark = np.argwhere(augment.warp(page, draw).mean(2) < 128)
        ((_, x0, y0, x1, y1),) = augment.warped_boxes([("b", 60 / 300, 40 / 200, 210 / 300, 120 / 200)], draw)
        low, high = dark.min(0), dark.max(0) + 1
        assert abs(low[0] - y0 * 200) <= 1.5 and abs(high[0] - y1 * 200) <= 1.5 and abs(low[1] - x0 * 300) <= 1.5 and abs(high[1] - x1 * 300) <= 1.5
    assert augment.warped_boxes([("a", None, 0.0, 1.0, 1.0), ("b", 0.5, 0.5, 0.5, 0.9), ("c", 2.0, 2.0, 3.0, 3.0)], augment.Draws(0, 0)) == []


def test_other_steps():
    draw, image = augment.Draws(3, 1), image_of(1, 200, 100)
    light = image.mean(2) > 200
    tinted = augment.tint(image, draw)
    assert (tinted[~light] == image[~light]).all() and 0 < np.abs(tinted - image).max() < 12
    assert np.abs(augment.aging(image, draw) - image).max() <= 0.08 * 255 + 1e-9
    share = ((n := augment.noise(np.full((1000, 1000, 3), 100), draw)) != 100).any(2).mean()
    assert abs(share - augment.NOISE) < 0.0005 and set(np.unique(n)) == {0, 100, 255}
    holes = (augment.cutout(np.zeros((200, 100, 3)), draw) == 255).all(2).sum()
    assert 0 < holes <= 2 * 16 * 8
    lights = [augment.shadow(np.full((50, 40, 3), 200.0), augment.Draws(0, k)) for k in range(40)]
    assert all(0.72 * 200 <= x.min() < 180 and x.max() == 200 for x in lights) and len({x.tobytes() for x in lights}) == 5
    assert np.allclose(augment.degrade(np.full((31, 17, 3), 90.0), draw), 90) and augment.degrade(image, draw).std() < image.std()


def test_rows_alone_decide(spark):
    rows = [(k, image_of(k % 5, 12, 9).tolist(), [("t", 0.1, 0.2, 0.5, 0.6)] if k % 2 else None) for k in range(24)]
    rows += [(100, None, [("t", 0.0, 0.0, 1.0, 1.0)]), (101, [], None), (102, [[[1, 2, 3]], [[1, 2, 3], [4, 5, 6]]], None), (103, [[[1, 2]]], None)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit(1))
    steps = ("tint", "aging", "shadow", "cutout", "noise", "degrade", "warp")
    read = lambda n: {r.id: (r.image, r.boxes) for r in augment.augmented(pages.repartition(n), steps, F.col("id"), seed=4).collect()}
    one, other = read(1), read(7)
    assert one == other and len(one) == 28
    assert one[0][0] != one[5][0] and np.array(one[0][0]).shape == (12, 9, 3) and len(one[1][1]) == 1 and one[0][1] == []
    assert all(one[k] == (None, []) for k in (100, 101, 102, 103))
    assert augment.augmented(pages, (), F.col("id")).where("id < 24").exceptAll(pages.where("id < 24").withColumn("boxes", F.coalesce("boxes", F.array().cast(pages.schema["boxes"].dataType)))).count() == 0
    with pytest.raises(ValueError):
        augment.augmented(pages, ("blur",), F.col("id"))
