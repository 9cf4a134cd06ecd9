"""From differences to corrections: which block a difference belongs to, what to change, and whether a run is sound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as t
from pagewright.operators.documents import ACADEMIC_HEADINGS
from pagewright.shared import cut


def blocks_of_diffs(diffs: DataFrame, blocks: DataFrame) -> DataFrame:
    """diffs (doc_id, diff_id, diff_type, ref_text, gen_text, is_heading_like, has_numbering) with the `block_id` of the most
    similar block: above .8, for headings among headings above .6, where a numbering prefix may be left off."""
    wanted = diffs.withColumn("__text", F.when(F.col("diff_type") == "missing", F.col("ref_text")).otherwise(F.col("gen_text"))).where(F.coalesce("__text", F.lit("")) != "")
    met = wanted.join(blocks.select("doc_id", "block_id", F.col("ord").alias("__ord"), "block_type", F.col("text").alias("__block")), "doc_id")
    is_heading = F.col("block_type") == "heading"
    plain = t.block_similarity(F.col("__text"), F.col("__block"))
    bare = F.when(F.col("has_numbering") & is_heading, t.block_similarity(t.strip_numbering(F.col("__text")), F.col("__block"))).otherwise(0.0)
    met = met.where(~F.col("is_heading_like") | is_heading).withColumn("__score", F.greatest(plain, bare))
    least = F.when(F.col("is_heading_like"), 0.6).otherwise(0.8)
    best = met.where(F.col("__score") > least).groupBy("doc_id", "diff_id").agg(F.max_by("block_id", F.struct("__score", -F.col("__ord"))).alias("block_id"))
    return diffs.join(best, ["doc_id", "diff_id"], "left")


def numbering_wanted(diffs: DataFrame) -> DataFrame:
    """Documents in which at least two numbered headings are surely missing."""
    sure = (F.col("diff_type") == "missing") & F.col("has_numbering") & F.col("is_heading_like") & (F.col("confidence") == 1.0)
    return diffs.where(sure).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_missing")).where("n_missing >= 2")


def numbered_sections(headings: DataFrame, columns: DataFrame) -> DataFrame:
    """Whether sections are numbered: two columns and two headings of level 1, or three academic ones."""
    academic = F.lower("text").rlike("|".join(ACADEMIC_HEADINGS[:17]))
    found = headings.where("level = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(academic).alias("a"))
    met = columns.join(found, "doc_id", "left").na.fill(0, ["n", "a"])
    return met.select("doc_id", (((F.col("columns") > 1) & (F.col("n") >= 2)) | (F.col("a") >= 3)).alias("numbered"))


def corrected_levels(headings: DataFrame, outline: DataFrame) -> DataFrame:
    """headings with the level that a reference outline has for their title; of repeated titles the last counts."""
    key = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"^[\d.]+\s*", "")
    known = outline.groupBy("doc_id", key("title").alias("__key")).agg(F.max_by("level", "ord").alias("__level"))
    met = headings.withColumn("__key", key("text")).join(known, ["doc_id", "__key"], "left")
    return met.withColumn("level", F.coalesce("__level", "level")).drop("__key", "__level")


def font_correction(ratio: Column, size: Column) -> Column:
    """A font size that is off by more than 5 % is scaled, within 8 to 12 points."""
    return F.when(ratio > 1.05, F.greatest(F.lit(8.0), F.least(F.lit(12.0), size / ratio))).otherwise(size)


def metric_ratios(metrics: DataFrame) -> DataFrame:
    """gen over ref of each page metric, 1 where the reference has none; metrics: doc_id, side and numbers."""
    names = [c for c in metrics.columns if c not in ("doc_id", "side")]
    ref, gen = (metrics.where(F.col("side") == s).select("doc_id", *[F.col(c).alias(f"{s}_{c}") for c in names]) for s in ("ref", "gen"))
    return ref.join(gen, "doc_id").select("doc_id", *[F.when(F.coalesce(f"ref_{c}", F.lit(0)) == 0, 1.0).otherwise(F.col(f"gen_{c}") / F.col(f"ref_{c}")).alias(f"{c}_ratio") for c in names])


def header_region(regions: DataFrame, least: float = 0.08, most: float = 0.5, pad: float = 0.02) -> DataFrame:
    """Each document's header box over the whole width, padded downward: the surest header region near the top of its page,
    if its height is plausible."""
    some = regions.where((F.lower("label") == "header") & (F.col("confidence") >= 0.6) & (F.col("y0") <= 0.35))
    best = some.groupBy("doc_id").agg(F.min_by(F.struct("y0", "y1"), F.struct(-F.col("confidence"), F.col("y0"))).alias("b")).select("doc_id", "b.*")
    fits = best.where((F.col("y1") - F.col("y0")).between(least, most))
    padded = F.least(F.lit(1.0), F.col("y1") + pad, F.col("y0") + most)
    return fits.select("doc_id", F.lit(0.0).alias("x0"), "y0", F.lit(1.0).alias("x1"), padded.alias("y1"), F.greatest(F.col("y1") - F.col("y0"), padded - F.col("y0")).alias("ratio"))


def textbox_regions(drawings: DataFrame) -> DataFrame:
    """Drawn rectangles that enclose text: neither small nor the page's background; filled ones are surer."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    page_w, page_h = F.col("page_width"), F.col("page_height")
    some = drawings.where((w >= 50) & (h >= 20) & ~((w > page_w * 0.95) & (h > page_h * 0.95)) & F.col("type").isin("s", "f", "fs"))
    return some.select("doc_id", "page", "ord", (F.col("x0") / page_w).alias("x0"), (F.col("y0") / page_h).alias("y0"), (F.col("x1") / page_w).alias("x1"), (F.col("y1") / page_h).alias("y1"), F.lit("textbox").alias("label"), F.when(F.col("type").isin("f", "fs"), 0.8).otherwise(0.5).alias("confidence"), F.lit("heuristic").alias("source"))


def table_regions(contours: DataFrame) -> DataFrame:
    """Contours of ruled lines that make a table: wide, high, crossed often enough, not a bar. Sizes in pixels."""
    w, h = F.col("width") / F.col("page_width"), F.col("height") / F.col("page_height")
    density = F.col("intersections") / (F.col("width") * F.col("height") / 10_000)
    aspect = F.greatest(F.col("width") / F.col("height"), F.col("height") / F.col("width"))
    return contours.where((w >= 0.2) & (h >= 0.05) & (F.col("intersections") >= 4) & (density >= 0.5) & (aspect <= 20)).withColumn("label", F.lit("table")).withColumn("confidence", F.lit(0.85))


def build_errors(lines: DataFrame, limit: int = 200) -> DataFrame:
    """Each build's first error: the first line with a leading `!` or an `:error:` in it, cut to `limit` characters."""
    found = lines.where(F.col("line").startswith("!") | F.contains(F.lower("line"), F.lit(":error:")))
    return found.groupBy("doc_id").agg(F.left(F.min_by("line", "line_no"), F.lit(limit)).alias("first_error"))


def run_issues(runs: DataFrame, least_size: int = 1000) -> DataFrame:
    """What is wrong with each document's run; empty arrays for sound ones. A missing or tiny output hides the rest."""
    small = F.col("gen_size").isNull() | (F.col("gen_size") < least_size)
    both = (F.col("ref_pages") > 0) & (F.col("gen_pages") > 0)
    other = F.array_compact(F.array(
        F.when(F.col("exit_code") != 0, F.lit("BUILD_FAILED")), F.when(F.col("gen_blocks") < 20, F.lit("FEW_BLOCKS")),
        F.when(both & (F.abs(F.col("ref_pages") - F.col("gen_pages")) > F.greatest(F.lit(1.0), F.col("ref_pages") * 0.2)), F.lit("PAGE_COUNT")),
        F.when(F.coalesce("has_empty_pages", F.lit(False)), F.lit("EMPTY_PAGES")), F.when(F.col("report_time") < F.col("gen_time"), F.lit("STALE_REPORT")),
    ))
    first = F.when(F.col("gen_size").isNull(), "MISSING").otherwise("TOO_SMALL")
    return runs.select("doc_id", F.when(small, F.array(first)).otherwise(other).alias("issues"))


#: The order in which corrections apply: whole documents first, then regions.
RULES = ("section_numbering", "pagination", "two_columns", "missing_elements", "pdf_metrics", "local")


def applied(state: DataFrame, rules: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """The state after all rules in their fixed order, and (doc_id, step, rule, fix) for what they changed. Each rule takes the state
    that the one before left, and returns the next one and its fixes (doc_id, fix)."""
    unknown = set(rules) - set(RULES)
    if unknown:
        raise ValueError(f"no such rule: {', '.join(sorted(unknown))}")
    fixes = None
    for step, name in enumerate(r for r in RULES if r in rules):
        state, found = rules[name](state)
        found = found.select("doc_id", F.lit(step).alias("step"), F.lit(name).alias("rule"), "fix")
        fixes = found if fixes is None else fixes.unionByName(found)
    return state, fixes


def recovered_figures(blocks: DataFrame, diffs: DataFrame, width: float = 6.0) -> DataFrame:
    """blocks (doc_id, ord, block_type, caption, width) with a figure behind the last block for each missing region that is
    kept as an image; pages in captions count from 1. diffs: doc_id, diff_id, ref_block_type, ref_page."""
    kind = F.coalesce("ref_block_type", F.lit("Element"))
    last = blocks.groupBy("doc_id").agg(F.max("ord").alias("__last"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("diff_id"))
    made = diffs.withColumn("__k", place).join(last, "doc_id", "left")
    made = made.select("doc_id", (F.coalesce("__last", F.lit(-1)) + F.col("__k")).cast("long").alias("ord"), F.lit("figure").alias("block_type"), F.format_string("Recovered %s (Page %d)", kind, F.col("ref_page") + 1).alias("caption"), F.lit(width).alias("width"))
    return blocks.select("doc_id", F.col("ord").cast("long").alias("ord"), "block_type", "caption", F.col("width").cast("double").alias("width")).unionByName(made)


def corpus_summary(docs: DataFrame, score: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.count_if(F.col(score) >= 0.8).alias("good"), F.count_if((F.col(score) >= 0.5) & (F.col(score) < 0.8)).alias("fair"), F.count_if(F.col(score) < 0.5).alias("poor"))


def fit_pages(targets: DataFrame, measured: DataFrame, start: float = 0.9, tries: int = 8) -> DataFrame:
    """(doc_id, squeeze, pages, tries): a walk to the target page count: 0.08 down if too long, 0.02 up if too short, up to
    `tries` steps. measured (doc_id, step, pages) says how many pages a squeeze gives, step being a hundredth; the walk ends
    where it isn't measured. Of equally near squeezes the first counts."""
    pages = measured.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("step").cast("int"), F.col("pages").cast("int")))).alias("at"))
    met = targets.join(pages, "doc_id")
    state = F.struct(F.lit(int(round(start * 100))).alias("step"), F.lit(None).cast("int").alias("best"), F.lit(None).cast("int").alias("got"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def walk(s: Column, _: Column) -> Column:
        got = F.try_element_at(F.col("at"), s["step"])
        diff = got - F.col("target")
        nearer = s["got"].isNull() | (F.abs(diff) < F.abs(s["got"] - F.col("target")))
        moved = F.struct(
            F.when(diff > 0, s["step"] - 8).when(diff < 0, s["step"] + 2).otherwise(s["step"]).cast("int").alias("step"), F.when(nearer, s["step"]).otherwise(s["best"]).alias("best"), F.when(nearer, got).otherwise(s["got"]).alias("got"),
            (s["n"] + 1).alias("n"), (diff == 0).alias("done"),
        )
        ended = F.struct(s["step"].alias("step"), s["best"].alias("best"), s["got"].alias("got"), s["n"].alias("n"), F.lit(True).alias("done"))
        return F.when(s["done"] | got.isNull(), ended).otherwise(moved)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), state, walk)
    return met.select("doc_id", end.alias("e")).select("doc_id", (F.col("e.best") / 100).alias("squeeze"), F.col("e.got").alias("pages"), F.col("e.n").alias("tries"))


def feedback(state: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, float, int]], most: int = 3, enough: float = 0.95) -> DataFrame:
    """Repeats a correction step until its match rate is enough, it changes nothing or `most` rounds are over. Each round's
    table is written to the checkpoint folder, so plans don't grow."""
    for _ in range(most):
        state, rate, fixes = step(state)
        state = cut(state)
        if rate >= enough or not fixes:
            break
    return state
