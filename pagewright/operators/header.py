"""A document's header kept as an image: how high it is, and what its place in the blocks becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The header's share of the page where nothing says it, twips of an inch.
HEADER_RATIO, TWIPS = 0.25, 1440.0


def grid_header_ratio(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, ratio): the height of the rows before the first heading row of a document's first layout grid, over the page's
    height (inches); of a grid that is all header, of all its rows. Null where there is no heading row below the first
    one, or no height. rows: doc_id, table_id, row_idx, height (twips), is_heading, header_only; missing heights count as 0."""
    first = rows.groupBy("doc_id").agg(F.min("table_id").alias("table_id"))
    heading = F.min(F.when(F.col("is_heading"), F.col("row_idx"))).over(Window.partitionBy("doc_id", "table_id"))
    mine = rows.join(first, ["doc_id", "table_id"], "left_semi").withColumn("__heading", heading)
    above = mine.groupBy("doc_id").agg(F.sum(F.when(F.col("header_only") | (F.col("row_idx") < F.col("__heading")), F.coalesce("height", F.lit(0)))).alias("twips"))
    ratio = F.when(F.col("twips") > 0, F.col("twips") / TWIPS / F.col("page_height"))
    return above.join(pages.select("doc_id", "page_height"), "doc_id").select("doc_id", ratio.alias("ratio"))


def header_fallbacks(docs: DataFrame, detected: DataFrame, grid: DataFrame, pad: float = 0.02, most: float = 0.5, ratio: float = HEADER_RATIO) -> DataFrame:
    """(doc_id, y0, y1, ratio, height, source) of each CV whose header becomes an image: a detected box, else the grid's height,
    else a set share of the page, padded downward. Where `is_complex` is false the header stays text. docs: doc_id, doc_type,
    page_height, is_complex; detected: doc_id, y0, y1; grid: doc_id, ratio."""
    met = docs.where((F.col("doc_type") == "resume") & F.coalesce("is_complex", F.lit(True)))
    met = met.join(detected.select("doc_id", "y0", "y1"), "doc_id", "left").join(grid.select("doc_id", F.col("ratio").alias("__grid")), "doc_id", "left")
    low, high = F.coalesce("y0", F.lit(0.0)), F.coalesce("y1", "__grid", F.lit(ratio))
    padded = F.least(F.lit(1.0), high + pad, low + most)
    source = F.when(F.col("y1").isNotNull(), "detected").when(F.col("__grid").isNotNull(), "grid").otherwise("default")
    found = met.select("doc_id", "page_height", low.alias("y0"), padded.alias("y1"), source.alias("source"))
    share = F.col("y1") - F.col("y0")
    return found.select("doc_id", "y0", "y1", share.alias("ratio"), (share * F.col("page_height")).alias("height"), "source")


def with_header_figure(blocks: DataFrame, fallbacks: DataFrame, contact: Column) -> DataFrame:
    """blocks after a fallback: header blocks and leading contact or blank ones go, and a figure is put before the first
    layout grid, or first. blocks: doc_id, ord, scope, block_type, text; documents without a fallback stay as they are."""
    marked = blocks.join(fallbacks.select("doc_id", F.lit(True).alias("__on")), "doc_id", "left")
    body = Window.partitionBy("doc_id", "scope").orderBy("ord")
    is_figure_place = (F.col("block_type") == "layout_grid") & (F.col("scope") == "body")
    leading = ~F.bool_or(~contact).over(body.rowsBetween(Window.unboundedPreceding, 0)) & (F.col("scope") == "body")
    kept = marked.withColumn("__lead", leading).where(F.col("__on").isNull() | ((F.col("scope") != "header") & ~F.col("__lead")))
    kept = kept.select("doc_id", F.col("ord").cast("double").alias("ord"), "scope", "block_type", "text")
    grids = kept.where(is_figure_place).groupBy("doc_id").agg(F.min("ord").alias("grid"))
    tops = kept.where(F.col("scope") == "body").groupBy("doc_id").agg(F.min("ord").alias("top"))
    at = F.coalesce(F.col("grid"), F.col("top"), F.lit(0.0)) - 0.5
    figures = fallbacks.select("doc_id").join(grids, "doc_id", "left").join(tops, "doc_id", "left").select("doc_id", at.alias("ord"), F.lit("body").alias("scope"), F.lit("figure").alias("block_type"), F.lit("HEADER_IMAGE_FALLBACK").alias("text"))
    return kept.unionByName(figures)
