"""Tables that scanners make of pages: regions, images, OCR words, hints, and what is joined, counted or reused of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.operators import calibration, corrections, layout

REGION = ("doc_id", "page", "ord", "x0", "y0", "x1", "y1", "label", "confidence", "source")


def figure_regions(images: DataFrame) -> DataFrame:
    """The places where images are drawn, as normalised regions that are sure."""
    at = lambda c, size: (F.col(c) / F.col(size)).alias(c)
    return images.select("doc_id", "page", "ord", at("x0", "page_width"), at("y0", "page_height"), at("x1", "page_width"), at("y1", "page_height"), F.lit("figure").alias("label"), F.lit(1.0).alias("confidence"), F.lit("heuristic").alias("source"))


def heuristic_regions(images: DataFrame, drawings: DataFrame, contours: DataFrame) -> DataFrame:
    """Figures, text boxes and tables of all pages, in this order on each page. contours: as for table_regions, with x, y."""
    x, y, w, h = F.col("x") / F.col("page_width"), F.col("y") / F.col("page_height"), F.col("width") / F.col("page_width"), F.col("height") / F.col("page_height")
    ruled = corrections.table_regions(contours).select("doc_id", "page", "ord", x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"), "label", "confidence", F.lit("heuristic").alias("source"))
    parts = [figure_regions(images), corrections.textbox_regions(drawings), ruled]
    rows = None
    for kind, part in enumerate(parts):
        part = part.select(*REGION).withColumn("__kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("__kind", "ord"))
    return rows.withColumn("place", place).drop("__kind")


def page_analysis(styles: DataFrame, regions: DataFrame) -> DataFrame:
    """Style and regions of each document's first page; documents without regions have none."""
    found = regions.where("page = 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "confidence"))).alias("regions"))
    return styles.where("page = 0").drop("page").join(found, "doc_id", "left").withColumn("regions", F.coalesce("regions", F.array().cast(found.schema["regions"].dataType)))


def image_counts(images: DataFrame) -> DataFrame:
    """Images on each page that has some, and of the document."""
    pages = images.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_images"))
    return pages.withColumn("n_document", F.sum("n_images").over(Window.partitionBy("doc_id")))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of OCR words (doc_id, page, block, line, ord, text, confidence) with the box about them and the mean confidence, 1
    where none is known."""
    return _joined_words(words, ["doc_id", "page", "block", "line"], ["ord"])


def ocr_blocks(words: DataFrame) -> DataFrame:
    """The same for whole blocks."""
    return _joined_words(words, ["doc_id", "page", "block"], ["line", "ord"])


def _joined_words(words: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda s: s["text"]), " ")
    box = [f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    return words.groupBy(*by).agg(text.alias("text"), F.coalesce(F.avg("confidence"), F.lit(1.0)).alias("confidence"), *box)


def reused(wanted: DataFrame, cached: DataFrame, fresh: DataFrame, on: list[str]) -> DataFrame:
    """wanted with cached results where there are some, else with fresh ones, and `from_cache`."""
    values = [c for c in cached.columns if c not in on]
    old = wanted.join(cached, on).withColumn("from_cache", F.lit(True))
    new = wanted.join(cached.select(*on), on, "left_anti").join(fresh.select(*on, *values), on, "left").withColumn("from_cache", F.lit(False))
    return old.unionByName(new)


def layout_hints(spans: DataFrame, columns: DataFrame, regions: DataFrame, right_aligned: Column, section: Column, font: str = "Calibri") -> DataFrame:
    """One row of hints for each document: dominant font, right margin, mean line spacing, number of columns by page, regions,
    and section titles with their heights. spans: doc_id, ord, text, font, x0, y0, x1."""
    ids = spans.select("doc_id").distinct()
    fonts = layout.dominant_font(spans, ["doc_id"])
    margins = spans.groupBy("doc_id").agg(
        F.coalesce(F.max(F.when(right_aligned, F.col("x1"))), F.lit(0.0)).alias("right_margin"),
        F.transform(F.array_sort(F.collect_list(F.when(section, F.struct("ord", "text", "y0")))), lambda s: F.struct(s["text"].alias("text"), s["y0"].alias("y0"))).alias("section_positions"),
    )
    spacing = calibration.mean_line_spacing(spans, ["doc_id"])
    by_page = columns.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "columns"))).alias("columns"))
    found = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "ord", "label", "confidence", "source"))).alias("regions"))
    met = ids
    for part in (fonts, margins, spacing, by_page, found):
        met = met.join(part, "doc_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(met.schema[c].dataType)).alias(c)
    return met.select("doc_id", F.coalesce("font", F.lit(font)).alias("body_font_family"), "right_margin", F.coalesce("line_spacing", F.lit(0.0)).alias("line_spacing"), empty("columns"), empty("regions"), "section_positions", F.lit("canonical").alias("page_box_type"))


def with_hints(docs: DataFrame, hints: DataFrame) -> DataFrame:
    """docs with their hints as one struct; null for documents without."""
    packed = hints.select("doc_id", F.struct(*[c for c in hints.columns if c != "doc_id"]).alias("hints"))
    return docs.join(packed, "doc_id", "left")


def policy_stats(trace: DataFrame) -> DataFrame:
    """How often each reason decided, by document."""
    return trace.groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def annotation_counts(labels: DataFrame, by: list[str]) -> DataFrame:
    """Images and annotations of label tables; images without annotation (null class) count as images."""
    return labels.groupBy(*by).agg(F.count_distinct("file_name").alias("images"), F.count("class_id").alias("annotations"))


def best_epochs(rows: DataFrame, by: list[str], epoch: str, metrics: list[str]) -> DataFrame:
    """(by, metric, best, epoch): each metric's largest value and the first epoch that reached it."""
    long = rows.select(*by, epoch, F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "value")).where("value is not null")
    return long.groupBy(*by, "metric").agg(F.max("value").alias("best"), F.max_by(epoch, F.struct("value", -F.col(epoch))).alias(epoch))


def merged_settings(base: DataFrame, override: DataFrame) -> DataFrame:
    """Settings as (path, value) rows, nested ones by dotted paths: an overriding value replaces the one at its path and
    whatever lay below it, or above it, there; all others stay."""
    steps = lambda c: F.split(c, r"\.")
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(steps(c))), lambda n: F.array_join(F.slice(steps(c), 1, n), "."))
    below = base.select("path", F.explode(prefixes(F.col("path"))).alias("at")).join(override.select(F.col("path").alias("at")), "at", "left_semi").select("path")
    above = override.select(F.explode(prefixes(F.col("path"))).alias("path"))
    kept = base.join(below.unionAll(above).distinct(), "path", "left_anti")
    return kept.unionByName(override.select("path", "value"))
