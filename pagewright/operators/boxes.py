"""Joins of boxes with boxes of the same page by the area they share, and the text inside detected boxes.

Boxes have x0, y0, x1, y1 in one unit. Both sides are dealt to the cells of a grid that they touch, so only boxes near each other are compared, and a
pair that meets in several cells counts in one of them: the cell of the upper left corner of what they share. Nothing needs to be made
distinct afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as g

CORNERS = ("x0", "y0", "x1", "y1")


def _grid(sides: tuple[DataFrame, DataFrame], cells: int) -> tuple[float, float, float, float] | None:
    """Left, top, width and height of the grid's cells: twice the mean size of a box, but no more than `cells` along either axis of
    both sides' extent, so that a box of common size touches few cells and no box touches more than cells * cells."""
    stats = [s.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1"), F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0"))).first() for s in sides]
    if any(r[0] is None for r in stats):
        return None
    low, high, top, bottom = min(r[0] for r in stats), max(r[1] for r in stats), min(r[2] for r in stats), max(r[3] for r in stats)
    size = lambda mean, extent: max(2 * float(mean), float(extent) / cells, 1e-9)
    return float(low), float(top), size(max(r[4] for r in stats), high - low), size(max(r[5] for r in stats), bottom - top)


def overlapping(a: DataFrame, b: DataFrame, by: list[str], key_a: str, key_b: str, least: float = 0.0, of: str = "a", cells: int = 64) -> DataFrame:
    """by, `a`, `b` (the keys of both) and `share` of all pairs of boxes of one page that share more than `least` of the area of the smaller one (`of` = "min"), of a's
    or of b's. Keys are unique on their page. Boxes without an area, inverted ones and those with a null corner share nothing."""
    whole = lambda df: df.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    a, b = (whole(df).select(*by, F.col(key).alias(f"__key_{s}"), *[F.col(c).cast("double").alias(c) for c in CORNERS]) for df, key, s in ((a, key_a, "a"), (b, key_b, "b")))
    grid = _grid((a, b), cells)
    if grid is None:
        return a.limit(0).select(*by, F.col("__key_a").alias("a")).join(b.limit(0).select(*by, F.col("__key_b").alias("b")), by).withColumn("share", F.lit(0.0))
    left, top, wide, high = grid
    column, row = lambda v: F.floor((v - left) / wide).cast("int"), lambda v: F.floor((v - top) / high).cast("int")

    def dealt(df: DataFrame, s: str) -> DataFrame:
        out = df.withColumn("__i", F.explode(F.sequence(column(F.col("x0")), column(F.col("x1"))))).withColumn("__j", F.explode(F.sequence(row(F.col("y0")), row(F.col("y1")))))
        return out.select(*by, "__i", "__j", f"__key_{s}", *[F.col(c).alias(f"{s}_{c}") for c in CORNERS])

    one, other = g.box("a_"), g.box("b_")
    met = dealt(a, "a").join(dealt(b, "b"), [*by, "__i", "__j"])
    met = met.where((column(F.greatest(one.x0, other.x0)) == F.col("__i")) & (row(F.greatest(one.y0, other.y0)) == F.col("__j")))
    base = {"a": one.area, "b": other.area, "min": F.least(one.area, other.area)}[of]
    return met.select(*by, F.col("__key_a").alias("a"), F.col("__key_b").alias("b"), (g.overlap(one, other) / base).alias("share")).where(F.col("share") > least)


def clipped_text(regions: DataFrame, words: DataFrame, by: list[str], region: str = "region_id", word: str = "word_id", least: float = 0.5, line: Column | None = None) -> DataFrame:
    """regions with `text`, that of the words of which more than `least` of the area is inside, and `n_words`; regions without text are dropped. Words
    are in reading order: lines from top to bottom (`line`, by default the rounded top edge), in a line from left to right, ties by the word's key.
    A line ends with a line end, words are parted by a space. A word may be in several regions; blank words and null ones count for
    nothing."""
    said = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("__line", line if line is not None else F.bround("y0", 1))
    inside = overlapping(regions, said, by, region, word, least, of="b").select(*by, F.col("a").alias("__region"), F.col("b").alias("__word"))
    told = inside.join(said.select(*by, F.col(word).alias("__word"), "__line", F.col("x0").alias("__x"), F.trim("text").alias("__text")), [*by, "__word"])
    joined = lambda parts, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts, "__text"))), lambda s: s["__text"]), sep).alias("__text")
    lines = told.groupBy(*by, "__region", "__line").agg(joined(("__x", "__word"), " "), F.count(F.lit(1)).alias("n_words"))
    texts = lines.groupBy(*by, "__region").agg(joined(("__line",), "\n"), F.sum("n_words").alias("n_words"))
    return regions.drop("text", "n_words").join(texts.select(*by, F.col("__region").alias(region), F.col("__text").alias("text"), "n_words"), [*by, region])
