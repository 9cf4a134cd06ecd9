"""Layout profiles, page style and hints, and the rest of the column-wise document operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.operators import layout
from pagewright.operators.documents import profile_name

#: Font size, line spacing, squeeze and section spacing of each kind of document.
PROFILES = {"academic_twocol": (10.0, 1.1, 1.0, 0.8), "academic_singlecol": (11.0, 1.15, 1.0, 1.0), "resume": (10.5, 1.0, 1.0, 0.7), "default": (11.0, 1.15, 1.0, 1.0)}
FIELDS = ("font_size", "line_spacing", "squeeze", "section_spacing")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], "profile string, " + ", ".join(f"p_{f} double" for f in FIELDS))


def calibrated(docs: DataFrame, known: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, doc_type, font_size?, section_spacing?) with the values of their type's profile (unknown types take the
    default's): font size and section spacing only where none is set, the others always. A measured font size
    (doc_id, measured_size) goes before the profile's."""
    named = docs.withColumn("profile", F.when(profile_name(F.col("doc_type")).isin(*PROFILES), profile_name(F.col("doc_type"))).otherwise("default"))
    met = named.join(known, "profile")
    met = met.join(measured, "doc_id", "left") if measured is not None else met.withColumn("measured_size", F.lit(None).cast("double"))
    size = F.coalesce("font_size", F.when(F.col("measured_size") > 0, F.col("measured_size")), "p_font_size")
    return met.select("doc_id", "profile", size.alias("font_size"), F.col("p_line_spacing").alias("line_spacing"), F.col("p_squeeze").alias("squeeze"), F.coalesce("section_spacing", "p_section_spacing").alias("section_spacing"))


def overridden(calibrated_docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Calibrated documents with per-document overrides (doc_id, param, value)."""
    wide = overrides.groupBy("doc_id").pivot("param", list(FIELDS)).agg(F.first("value"))
    met = calibrated_docs.join(wide.select("doc_id", *[F.col(f).alias(f"o_{f}") for f in FIELDS]), "doc_id", "left")
    return met.select("doc_id", "profile", *[F.coalesce(f"o_{f}", f).alias(f) for f in FIELDS])


def measured_spacing(line_height: Column, font_size: Column, squeeze: Column, fallback: Column) -> Column:
    """Line spacing from a page's measures, unless the document is being squeezed."""
    return F.when((squeeze < 0.99) | (font_size <= 0) | font_size.isNull() | line_height.isNull(), fallback).otherwise(line_height / font_size)


def gate_mode(mode: Column) -> Column:
    return F.coalesce(mode, F.lit("enforce"))


def page_style(spans: DataFrame, by: list[str]) -> DataFrame:
    """Left margin in inches, share of serif fonts and the family it stands for, and the right margin of right-aligned text
    (beyond 500 points)."""
    serif = F.lower("font").rlike("serif|roman|times")
    out = spans.groupBy(*by).agg((F.min("x0") / 72).alias("margin_left"), F.avg(serif.cast("double")).alias("serif_share"), F.max(F.when(F.col("x1") > 500, F.col("x1"))).alias("right_margin"))
    return out.withColumn("family", F.when(F.col("serif_share") > 0.4, "serif").otherwise("sans"))


def mean_line_spacing(spans: DataFrame, by: list[str], most: int = 50) -> DataFrame:
    """Mean of the gaps between 8 and 25 among the first `most` distinct heights (rounded to a tenth) of a document."""
    heights = spans.select(*by, F.bround("y0", 1).alias("y")).distinct()
    first = heights.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("y"))).where(F.col("k") <= most)
    return layout.gaps(first.drop("k"), by, "y").where((F.col("gap") > 8) & (F.col("gap") < 25)).groupBy(*by).agg(F.avg("gap").alias("line_spacing"))


def region_summary(regions: DataFrame, known: tuple[str, ...], first: int = 20) -> DataFrame:
    """Counts per document by canonical label (others count as text) and the first regions, `first` of them."""
    label = F.when(F.lower("label").isin(*known), F.lower("label")).otherwise("text")
    rows = regions.withColumn("label", label)
    counts = rows.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("by_label"))
    head = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("k") <= first)
    return counts.join(head.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("head")), "doc_id")


def tab_segments(spans: DataFrame, stops: DataFrame) -> DataFrame:
    """Spans between tabs as segments, the k-th at the k-th tab stop (null where stops run out, and before the first tab).
    A stop that doesn't lie beyond the ones before it isn't taken."""
    w = Window.partitionBy("doc_id", "block").orderBy("ord")
    cut = spans.withColumn("segment", F.sum(F.col("is_tab").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("is_tab"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "")
    rows = cut.groupBy("doc_id", "block", "segment").agg(text.alias("text"))
    placed = rows.join(stops.select("doc_id", "block", F.col("k").cast("long").alias("segment"), "position"), ["doc_id", "block", "segment"], "left")
    before = F.max("position").over(Window.partitionBy("doc_id", "block").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("x", F.when(F.col("position") > F.coalesce(before, F.lit(0)), F.col("position"))).select("doc_id", "block", "segment", "text", "x")


def sidebar_split(cells: DataFrame, sidebar_first: Column) -> DataFrame:
    """The text of each document's layout grid, dealt to sidebar and main column by cell index."""
    part = F.when((F.col("cell_idx") == 0) == sidebar_first, "sidebar").otherwise("main")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cell_idx", "text"))), lambda s: s["text"]), "\n")
    return cells.withColumn("part", part).groupBy("doc_id").pivot("part", ["sidebar", "main"]).agg(joined)


def floating_blocks(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """Floating figures with the scope of the block that holds them; footers aren't searched."""
    held = blocks.select("doc_id", F.col("ord").alias("block"), F.col("scope").alias("in_scope"))
    return figures.where("floating").join(held, ["doc_id", "block"], "left").where("in_scope is null or in_scope <> 'footer'")


def page_averages(pages: DataFrame) -> DataFrame:
    """Per document: mean similarity over pages that both sides have, and over all pages, and the median absolute drift."""
    both = F.col("ref_present") & F.col("gen_present")
    return pages.groupBy("doc_id").agg(F.bround(F.avg(F.when(both, F.col("similarity"))), 4).alias("common"), F.bround(F.avg(F.when(both, F.col("similarity")).otherwise(0.0)), 4).alias("overall"), F.median(F.abs(F.when(both, F.col("drift")))).alias("median_drift"))


def merged_reports(reports: DataFrame, *others: DataFrame) -> DataFrame:
    """Reports with the columns of other reports on the same document."""
    for other in others:
        reports = reports.join(other, "doc_id", "left")
    return reports


def region_key(page: Column, label: Column, index: Column) -> Column:
    return F.format_string("p%d_%s_%03d", page, label, index)


def images_with_labels(images: DataFrame, files: DataFrame) -> DataFrame:
    """Image paths with the label file of the same stem; images without one are kept."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    return images.withColumn("stem", stem("path")).join(files.select(stem("path").alias("stem"), F.col("path").alias("label_path")), "stem", "left")


def merged_datasets(sets: dict[str, DataFrame]) -> DataFrame:
    """One table of several label sets, file names prefixed with the set's name."""
    parts = [df.withColumn("file_name", F.concat(F.lit(f"{name}_"), "file_name")) for name, df in sorted(sets.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
