"""Per-document reports, types, policies and runs over blocks, spans and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.shared import cut

#: Heading terms of papers and of CVs.
ACADEMIC_HEADINGS = (
    "introduction", "conclusion", "abstract", "appendix", "references", "acknowledgment", "acknowledgement", "methodology", "results", "discussion", "related work", "background",
    "evaluation", "experiments", "nomenclature", "paper preparation", "template", "literature review", "future work", "proposed method", "experimental setup",
)
RESUME_HEADINGS = (
    "education", "experience", "skills", "projects", "summary", "objective", "certifications", "awards", "publications", "references", "contact", "technical skills", "work experience",
    "academic projects", "professional experience", "employment", "qualifications",
)
#: Calibration profiles' names and other names for them.
PROFILE_ALIASES = {"academic": "academic_singlecol"}


def type_scores(headings: DataFrame, academic: tuple[str, ...] = ACADEMIC_HEADINGS, resume: tuple[str, ...] = RESUME_HEADINGS) -> DataFrame:
    """Per document: a heading with a term of a list counts 2 at level 1, else 1."""
    low = F.trim(F.lower("text"))
    points = F.when(F.col("level") == 1, 2).otherwise(1)
    hit = lambda terms: F.sum(F.when(low.rlike("|".join(terms)), points).otherwise(0))
    return headings.groupBy("doc_id").agg(hit(academic).alias("academic_score"), hit(resume).alias("resume_score"), F.count(F.lit(1)).alias("n_headings"))


def document_type(columns: Column, academic: Column, resume: Column, grids: Column) -> Column:
    return (
        F.when((columns > 1) & (academic >= 2), "academic_twocol").when(academic >= 4, "academic_singlecol").when((resume >= 3) | (grids >= 2), "resume").when(academic > resume, "academic_singlecol").otherwise("default")
    )


def profile_name(name: Column) -> Column:
    """Lower-case, with aliases resolved."""
    low = F.lower(F.trim(name))
    out = low
    for alias, full in PROFILE_ALIASES.items():
        out = F.when(low == alias, full).otherwise(out)
    return out


def conversion_report(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Counts per document by block type, table complexity and policy, with the ids of fallback blocks, and styled spans."""
    kinds = ("heading", "paragraph", "list", "table", "layout_grid", "figure", "textbox")
    is_kind = lambda k: F.col("block_type") == k
    score = F.when(is_kind("table"), F.col("complexity_score"))
    counted = blocks.groupBy("doc_id").agg(
        *[F.count_if(is_kind(k)).alias(f"n_{k}") for k in kinds], F.sum(F.coalesce("n_items", F.lit(0))).alias("n_list_items"),
        F.count_if(score <= 8).alias("tables_simple"), F.count_if((score > 8) & (score <= 18)).alias("tables_medium"), F.count_if(score > 18).alias("tables_complex"),
        F.count_if(F.col("policy") == "fallback").alias("n_fallback"), F.count_if(F.col("policy") == "semantic").alias("n_semantic"),
        F.array_sort(F.collect_list(F.when(F.col("policy") == "fallback", F.col("block_id")))).alias("fallbacks"),
    )
    styled = spans.groupBy("doc_id").agg(*[F.count_if(c).alias(f"n_{c}") for c in ("bold", "italic", "underline")])
    return counted.join(styled, "doc_id", "left").na.fill(0, ["n_bold", "n_italic", "n_underline"])


def feature_flags(blocks: DataFrame) -> DataFrame:
    """What a document's preamble needs."""
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return blocks.groupBy("doc_id").agg(
        any_of(F.col("block_type") == "table").alias("has_tables"), any_of(F.col("block_type") == "list").alias("has_lists"), any_of(F.col("block_type") == "figure").alias("has_figures"),
        any_of(F.col("floating")).alias("has_floats"), (F.coalesce(F.max("n_rows"), F.lit(0)) > 8).alias("needs_ltablex"), any_of(F.col("has_url")).alias("has_urls"), any_of(F.col("has_footnote")).alias("has_footnotes"),
    )


def table_complexity(cells: DataFrame, by: list[str], wide: int = 8, long: int = 30) -> DataFrame:
    """Policy score of tables: 2 for each merged cell, 3 for more than 8 cells in the first row, 3 for more than 30 rows."""
    merged = (F.col("col_span") > 1) | (F.col("row_span") > 1)
    out = cells.groupBy(*by).agg(F.count_if(merged).alias("merged"), F.count_if(F.col("row_idx") == 0).alias("first_row"), F.count_distinct("row_idx").alias("n_rows"))
    return out.withColumn("complexity", 2 * F.col("merged") + F.when(F.col("first_row") > wide, 3).otherwise(0) + F.when(F.col("n_rows") > long, 3).otherwise(0))


def parser_complexity(cells: DataFrame, by: list[str], wide: int = 8, long: int = 30) -> DataFrame:
    """Parser score of tables: 2 for each merged axis, and the widest row counts."""
    rows = cells.groupBy(*by, "row_idx").agg(F.sum((F.col("col_span") > 1).cast("int") + (F.col("row_span") > 1).cast("int")).alias("axes"), F.count(F.lit(1)).alias("n"))
    out = rows.groupBy(*by).agg(F.sum("axes").alias("axes"), F.max("n").alias("widest"), F.count(F.lit(1)).alias("n_rows"))
    return out.withColumn("complexity", 2 * F.col("axes") + F.when(F.col("widest") > wide, 3).otherwise(0) + F.when(F.col("n_rows") > long, 3).otherwise(0))


def table_policy(complexity: Column) -> tuple[Column, Column]:
    """Decision and reason for a table."""
    high = complexity > 18
    return F.when(high, "fallback").otherwise("semantic"), F.when(high, F.concat(F.lit("OOXML_COMPLEXITY_HIGH_"), complexity.cast("string"))).otherwise("OOXML_TRUTHS_TABLE")


def region_policy(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Decision for other blocks from the regions of their page: the first, in order, that decides; else semantic."""
    ml_table = (F.lower("label") == "table") & (F.col("source") != "heuristic") & (F.col("confidence") > 0.85)
    reason = F.when(ml_table, "ML_TABLE_HIGH_CONF_NO_OOXML").when(F.lower("label") == "textbox", "ORACLE_TEXTBOX_FLOATING")
    first = regions.withColumn("reason", reason).where("reason is not null").groupBy("doc_id", "page").agg(F.min_by("reason", "ord").alias("reason"))
    met = blocks.join(first, ["doc_id", "page"], "left").withColumn("reason", F.coalesce("reason", F.lit("DEFAULT_SEMANTIC")))
    return met.withColumn("decision", F.when(F.col("reason").startswith("ML_TABLE"), "fallback").otherwise("semantic"))


def cascade(preferred: DataFrame, fallback: DataFrame, by: str = "doc_id") -> DataFrame:
    """All preferred rows, and the fallback's of documents without one."""
    return preferred.unionByName(fallback.join(preferred.select(by).distinct(), by, "left_anti"))


def islands(rows: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """rows with `run`: a number for each stretch of neighbours that agree on `same`."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return rows.withColumn("__new", (first | changed).cast("int")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def list_runs(blocks: DataFrame) -> DataFrame:
    """Neighbouring list paragraphs of one numbering become one list; paragraphs without content neither end nor join it."""
    kept = blocks.where(F.col("num_id").isNull() | (F.col("content") != ""))
    runs = islands(kept, ["doc_id"], ["ord"], ["num_id"]).where("num_id is not null")
    return runs.groupBy("doc_id", "run", "num_id").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("items"), F.min_by("ordered", "ord").alias("ordered"))


def joined_spans(spans: DataFrame, style: list[str]) -> DataFrame:
    """Neighbouring spans of one style become one; tabs stay apart."""
    apart = spans.withColumn("__tab", F.when(F.col("is_tab"), F.col("ord")))
    runs = islands(apart, ["doc_id", "block_id"], ["ord"], [*style, "__tab"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "")
    return runs.groupBy("doc_id", "block_id", "run", *style).agg(F.min("ord").alias("ord"), text.alias("text"), F.bool_or("is_tab").alias("is_tab"))


def token_runs(tokens: DataFrame) -> DataFrame:
    """Neighbouring tokens of one label become a box in centre form; specks are dropped."""
    runs = islands(tokens, ["doc_id"], ["ord"], ["label"])
    boxes = runs.groupBy("doc_id", "run", "label").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.where((w > 0.01) & (h > 0.005)).select("doc_id", "run", "label", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), w.alias("w"), h.alias("h"))


def capped_text(parts: DataFrame, by: list[str], order: str, text: str, most: int) -> DataFrame:
    """Texts in order, joined by line ends, until `most` characters are reached: a text is added while the total before it
    is below, then the whole is cut."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    kept = parts.withColumn("__before", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))).where(F.col("__before") < most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n")
    return kept.groupBy(*by).agg(F.left(joined, F.lit(most)).alias("text"), F.count(F.lit(1)).alias("n_parts"))


def column_offsets(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells with `offset`, the columns before them in their row, and their table's `n_columns`."""
    row = Window.partitionBy(*by, "row_idx").orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("offset", F.coalesce(F.sum("col_span").over(row), F.lit(0)))
    return placed.withColumn("n_columns", F.max(F.col("offset") + F.col("col_span")).over(Window.partitionBy(*by)))


def without_prefix(blocks: DataFrame, drop: Column, stop: Column) -> DataFrame:
    """blocks from the first one on that isn't to be dropped, or that stops the search."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("__from", F.bool_or(~drop | stop).over(w)).where("__from").drop("__from")


def collapsed_gaps(blocks: DataFrame) -> DataFrame:
    """The space above each block with content: the larger of its own and the one below its predecessor; 0 for the first."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    return blocks.where(~F.col("is_empty")).withColumn("gap", F.coalesce(F.greatest(F.lag("spacing_after").over(w), F.col("spacing_before")), F.lit(0.0)))


def inherited(styles: DataFrame, value: str) -> DataFrame:
    """(doc_id, style_id, value): each style's own value, else its nearest ancestor's. Chains of any length are followed by
    joins of doubling reach, each written to the shared folder, until no style waits for an ancestor; as no chain is
    longer than there are styles, styles on a cycle without a value end there with null."""
    reach = cut(styles.select("doc_id", "style_id", F.col("based_on").alias("up"), F.col(value).alias("v")))
    steps, most = 1, reach.count()
    while steps <= most and reach.where("v is null and up is not null").limit(1).count():
        above = reach.select("doc_id", F.col("style_id").alias("up"), F.col("up").alias("__up"), F.col("v").alias("__v"))
        reach = cut(reach.join(above, ["doc_id", "up"], "left").select("doc_id", "style_id", F.when(F.col("v").isNull(), F.col("__up")).alias("up"), F.coalesce("v", "__v").alias("v")))
        steps *= 2
    return reach.select("doc_id", "style_id", F.col("v").alias(value))


def split_rows(rows: DataFrame, key: str, parts: int = 10, seed: int = 0) -> DataFrame:
    """rows with `split`: about one in `parts` is `val`, by a hash of the key and the seed."""
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("split", F.when(digest % parts == 0, "val").otherwise("train"))
