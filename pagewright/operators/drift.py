"""Drift, coverage and gates: how far a generated document is from its reference, and whether that is good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quartiles(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Median, quartiles and interquartile range of some columns, by linear interpolation; null for empty groups."""
    aggs = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__{c}") for c in columns]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    parts = []
    for c in columns:
        p25, p50, p75 = (F.col(f"__{c}")[k] for k in range(3))
        parts += [p25.alias(f"p25_{c}"), p50.alias(f"median_{c}"), p75.alias(f"p75_{c}"), (p75 - p25).alias(f"iqr_{c}")]
    return out.select(*by, "n", *parts)


def with_outliers(rows: DataFrame, by: list[str], columns: tuple[str, str], stats: DataFrame, times: float = 2.0) -> DataFrame:
    """stats with the number of rows whose distance from the median exceeds `times` the interquartile range: along the
    first column, else along the second."""
    met = rows.join(stats, by)
    far = [F.abs(F.col(c) - F.col(f"median_{c}")) > times * F.col(f"iqr_{c}") for c in columns]
    counted = met.groupBy(*by).agg(F.count_if(far[0]).alias(f"outliers_{columns[0]}"), F.count_if(~far[0] & far[1]).alias(f"outliers_{columns[1]}"))
    return stats.join(counted, by)


def label_summary(regions: DataFrame, by: list[str]) -> DataFrame:
    """Scores of the regions that could be scored, and what share of all regions that is, strictly and without tiny and
    blank ones."""
    scored = F.col("status") == "SCORED"
    score = F.when(scored, F.col("score"))
    out = regions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(scored).alias("count_scored"), F.avg(score).alias("avg"), F.percentile(score, 0.5).alias("p50"), F.percentile(score, 0.1).alias("p10"), F.min(score).alias("min"),
        F.count_if(F.col("status") == "MISSING_PAGE").alias("missing"), F.count_if(F.col("status") == "TINY").alias("tiny"), F.count_if(F.col("status") == "BLANK").alias("blank"),
    )
    usable = F.col("total") - F.col("tiny") - F.col("blank")
    return out.withColumn("coverage_strict", F.coalesce(F.try_divide("count_scored", "total"), F.lit(0.0))).withColumn("coverage_effective", F.coalesce(F.try_divide("count_scored", usable), F.lit(0.0)))


def region_status(valid: Column, ref_page: Column, gen_page: Column, tiny: Column, blank: Column) -> Column:
    """The first that holds: an invalid box, a page that one side lacks, a tiny region, one blank on both sides; else scored."""
    return F.when(~valid, "INVALID_BBOX").when(~ref_page | ~gen_page, "MISSING_PAGE").when(tiny, "TINY").when(blank, "BLANK").otherwise("SCORED")


def region_shifts(pairs: DataFrame, by: list[str], least: float = 20.0) -> DataFrame:
    """Number and sum of vertical shifts above `least` by group."""
    shift = F.abs(F.col("gen_y0") - F.col("ref_y0"))
    return pairs.withColumn("shift", shift).where(F.col("shift") > least).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("shift").alias("total")).withColumn("avg_shift", F.col("total") / F.col("n"))


def diff_counts(diffs: DataFrame, by: list[str]) -> DataFrame:
    kinds = ("missing", "extra", "shifted", "changed")
    return diffs.groupBy(*by).agg(*[F.count_if(F.col("diff_type") == k).alias(f"{k}_count") for k in kinds])


def overlay(defaults: DataFrame, overrides: DataFrame, labels: DataFrame, fallback: str = "title") -> DataFrame:
    """(doc_id, label, param, value) for each of labels(doc_id, label): the document's override, else the label's default,
    else, for a label without defaults, the fallback label's. The tables of settings are a configuration, a few rows per
    document; they are joined without hints."""
    known = defaults.select(F.col("label").alias("known")).distinct()
    used = labels.join(known, labels["label"] == known["known"], "left").withColumn("from_label", F.coalesce("known", F.lit(fallback))).drop("known")
    base = used.join(defaults.select(F.col("label").alias("from_label"), "param", "value"), "from_label").drop("from_label")
    own = overrides.join(labels, ["doc_id", "label"], "left_semi").select("doc_id", "label", "param", F.col("value").alias("own"))
    return base.join(own, ["doc_id", "label", "param"], "full_outer").select("doc_id", "label", "param", F.coalesce("own", "value").alias("value"))


#: Gates where a configuration sets none.
GATE_DEFAULTS = {"min_regions": 1.0, "hit_boundary_max": 0.0, "blank_gen_max": 0.0, "missing_page_max": 0.0, "median_abs_dy_max": 999.0, "median_abs_dx_max": 999.0, "coverage_min_effective": 0.70}


def gate_labels(stats: DataFrame, gates: DataFrame) -> DataFrame:
    """Each label's status (PASS, FAIL, SKIP) and the gates it violates. stats: doc_id, label, count_scored, hit_boundary,
    blank_gen, missing_page, median_dx, median_dy, coverage; gates: doc_id, label, param, value."""
    wide = gates.groupBy("doc_id", "label").pivot("param", list(GATE_DEFAULTS)).agg(F.first("value"))
    met = stats.join(wide, ["doc_id", "label"], "left").na.fill(GATE_DEFAULTS)
    zero = F.lit(0.0)
    checks = {
        "hit_boundary": F.col("hit_boundary") > F.col("hit_boundary_max"), "blank_gen": F.col("blank_gen") > F.col("blank_gen_max"), "missing_page": F.col("missing_page") > F.col("missing_page_max"),
        "median_dy": F.abs(F.coalesce("median_dy", zero)) > F.col("median_abs_dy_max"), "median_dx": F.abs(F.coalesce("median_dx", zero)) > F.col("median_abs_dx_max"), "coverage": F.col("coverage") < F.col("coverage_min_effective"),
    }
    few = F.col("count_scored") < F.col("min_regions")
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    violations = F.when(few, F.array(F.lit("regions"))).otherwise(found)
    status = F.when(few, "SKIP").when(F.size(found) > 0, "FAIL").otherwise("PASS")
    return met.select("doc_id", "label", status.alias("status"), violations.alias("violations"))


def gate_documents(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Each document's status and kind of warning from its labels' results and its pages (doc_id, ref_pages, gen_pages)."""
    failed = F.when(F.col("status") == "FAIL", F.col("violations"))
    has = lambda *v: F.coalesce(F.exists(failed, lambda x: x.isin(*v)), F.lit(False))
    found = labels.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "FAIL").alias("n_failed"), F.bool_or((F.col("status") == "FAIL") & (F.col("label") == "figure")).alias("figure"), F.bool_or(has("blank_gen")).alias("blank"),
        F.bool_or(has("median_dy", "median_dx")).alias("geometry"), F.bool_or(has("hit_boundary") & F.col("label").isin("title", "list")).alias("boundary"),
    )
    met = pages.join(found, "doc_id", "left").na.fill(False, ["figure", "blank", "geometry", "boundary"]).na.fill(0, ["n_failed"])
    diff = F.abs(F.col("gen_pages") - F.col("ref_pages"))
    status = F.when((diff >= 1) | (F.col("n_failed") > 0), "FAIL").otherwise("PASS")
    kind = (
        F.when(diff >= 2, "WARN_CATASTROPHIC_LAYOUT").when(diff == 1, "WARN_PAGE_COUNT").when(F.col("n_failed") == 0, F.lit(None).cast("string"))
        .when(F.col("figure") | F.col("blank"), "WARN_STRUCTURE_DRIFT").when(F.col("geometry") | F.col("boundary"), "WARN_STRUCTURAL_LAYOUT_MISMATCH")
    )
    return met.select("doc_id", status.alias("status"), kind.alias("warn_class"), F.when(diff >= 2, 0).otherwise(F.col("n_failed")).alias("n_failed"))


def page_verdict(page_match: Column, similarity: Column, drift: Column) -> Column:
    return (
        F.when(~page_match, "FAIL_PAGE_COUNT").when((similarity >= 0.9) & (drift < 10), "EXCELLENT").when(similarity >= 0.9, "GOOD_SSIM_DRIFTED").when(similarity >= 0.8, "GOOD").when(similarity >= 0.7, "ACCEPTABLE").otherwise("POOR")
    )


def validation_status(words: Column, images: Column, text: Column) -> Column:
    return F.when((words < 0.85) | (images > 10), "CRITICAL").when((words < 0.95) | (images > 0) | (text < 0.70), "WARNING").otherwise("OK")


def drift_warnings(most: Column, mean: Column) -> Column:
    return F.array_compact(F.array(F.when(most > 100, F.lit("MAX_DRIFT")), F.when(mean > 50, F.lit("AVG_DRIFT"))))


def corrected_spacing(inflation: Column, squeeze: Column, line_spacing: Column) -> tuple[Column, Column]:
    """Squeeze and line spacing after a page count that is off by more than 5 %: dampened, and kept within bounds."""
    shrink, grow = 1 / F.pow(inflation, F.lit(0.7)), 1 / F.pow(inflation, F.lit(0.5))
    new_squeeze = F.when(inflation > 1.05, F.greatest(F.lit(0.6), F.least(F.lit(1.0), squeeze * shrink))).when(inflation < 0.95, F.least(F.lit(1.2), squeeze * grow)).otherwise(squeeze)
    new_line = F.when(inflation > 1.05, F.greatest(F.lit(0.7), line_spacing * shrink)).otherwise(line_spacing)
    return new_squeeze, new_line


def corrected_block_spacing(current: Column, dy: Column, kind: Column) -> Column:
    """Space before a shifted block: less half of its shift in points, half more for titles; only changes above 1 count."""
    wanted = F.greatest(F.lit(0.0), current - dy * 792 * 0.5 * F.when(kind.isin("Title", "Heading"), 1.5).otherwise(1.0))
    return F.when(F.abs(wanted - current) > 1, wanted.cast("int").cast("double")).otherwise(current)


def worst(regions: DataFrame, order: list[str], k: int = 20) -> DataFrame:
    """The k rows with the lowest score; `order` breaks ties."""
    return regions.orderBy("score", *order).limit(k)
