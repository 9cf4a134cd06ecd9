"""What Word markup means: headings, layout tables, right-hand elements, font precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.functions.text import is_upper

#: Section titles of CVs that make a paragraph a heading.
CONTENT_HEADINGS = (
    "education", "experience", "skills", "projects", "summary", "objective", "certifications", "awards", "publications", "references", "contact", "technical skills", "work experience",
    "academic projects", "professional experience",
)
#: Weights of the signals for a layout table.
SIGNALS = {"borderless": 0.25, "merge_rate": 0.15, "row_variance": 0.10, "text_heavy": 0.15, "header_like": 0.20, "width": 0.15}


def heading_level(style_id: Column, name: Column, outline_level: Column) -> Column:
    """Level by style: outline level, name, then id; null if it is no heading style."""
    low, low_id = F.lower(F.coalesce(name, F.lit(""))), F.lower(style_id)
    number = lambda c: F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).cast("int")
    last_word = F.try_to_number(F.nullif(F.regexp_extract(low, r"(\d+)\s*$", 1), F.lit("")), F.lit("999")).cast("int")
    special = low.rlike("(head|header)$") & low.rlike("abs|ack|ccs|keyword|ref|meta")
    by_name = F.when(low.startswith("heading"), F.coalesce(last_word, F.lit(1))).when(low.isin("title", "titledocument"), 1).when(low.startswith("head") & number(low).isNotNull(), number(low)).when(special, 1)
    by_id = F.when(low_id.startswith("heading"), F.coalesce(number(low_id), F.lit(1)))
    return F.when(F.nullif(style_id, F.lit("")).isNotNull(), F.coalesce(outline_level + 1, by_name, by_id))


def is_content_heading(text: Column, all_bold: Column) -> Column:
    """A paragraph that is, or begins with, a known section title, and is bold or short."""
    low = F.lower(F.trim(text))
    known = F.exists(F.array(*[F.lit(h) for h in CONTENT_HEADINGS]), lambda h: (low == h) | F.startswith(low, F.concat(h, F.lit(" "))))
    return known & (all_bold | (F.length(F.trim(text)) < 50))


def layout_tables(cells: DataFrame, tables: DataFrame, page_width: int = 9360) -> DataFrame:
    """Each table's layout score and verdict. cells: doc_id, table_id, row_idx, cell_idx, col_span, v_merge, text,
    heading_style; tables: doc_id, table_id, has_borders, width (twips)."""
    by = ["doc_id", "table_id"]
    text = F.coalesce("text", F.lit(""))
    letters, digits = t.letters(text), t.digits(text)
    rows = cells.groupBy(*by, "row_idx").agg(
        F.sum("col_span").alias("columns"), F.count(F.lit(1)).alias("n"), F.sum((F.col("col_span") > 1).cast("int") + F.col("v_merge").cast("int")).alias("merged"), F.count_if("heading_style").alias("headings"),
        F.count_if((text != "") & (letters > digits * 3)).alias("texts"), F.count_if((text != "") & ((digits >= F.length(text) * 0.2) | t.has_math(text))).alias("numbers"),
        F.count_if((F.trim(text) != "") & ((is_upper(F.trim(text)) & (F.length(F.trim(text)) < 30)) | F.lower(F.trim(text)).isin(*CONTENT_HEADINGS))).alias("titles"),
    )
    titles = F.when((F.col("row_idx") == 0) | (F.col("n") <= 2), F.col("titles")).otherwise(0)
    whole = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("columns").alias("n_cols"), F.sum("n").alias("n_cells"), F.sum("merged").alias("merged"), F.sum("headings").alias("headings"), F.sum("texts").alias("texts"),
        F.sum("numbers").alias("numbers"), F.sum(titles).alias("titles"), F.stddev_pop("columns").alias("sd"), F.avg("columns").alias("mean"),
    )
    one = F.lit(1.0)
    share = F.col("width") / page_width
    met = whole.join(tables, by, "left").select(
        *by, "n_rows", "n_cols", F.when(F.col("has_borders"), 0.0).otherwise(1.0).alias("borderless"), F.least(one, F.col("merged") / F.col("n_cells") * 2).alias("merge_rate"),
        F.when(F.col("n_rows") > 1, F.least(one, F.col("sd") / F.greatest(F.col("mean"), one))).otherwise(0.0).alias("row_variance"), (F.col("texts") / F.col("n_cells")).alias("text_heavy"),
        F.least(one, F.col("titles") / F.col("n_rows")).alias("header_like"), F.when(share >= 0.8, 1.0).when(share >= 0.6, 0.5).otherwise(0.0).alias("width"), (F.col("headings") > 0).alias("has_heading"), (F.col("numbers") / F.col("n_cells")).alias("digit_share"),
    )
    score = sum(F.col(k) * w for k, w in SIGNALS.items())
    score = F.when(F.col("has_heading"), F.least(one, score + 0.15)).otherwise(score)
    regular = (F.col("n_rows") >= 3) & (F.col("n_cols") >= 3) & (F.col("row_variance") < 0.1) & (F.col("header_like") < 0.1)
    held = (regular | (F.col("digit_share") >= 0.4)) & (F.col("borderless") + F.col("width") < 1.8)
    return met.withColumn("score", F.when(held, F.least(score, F.lit(0.4))).otherwise(score)).withColumn("is_layout", F.col("score") >= 0.45)


#: Patterns of dates and places.
MONTHS = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)\b"
PLACE, YEAR = r",\s*[A-Z]{2}\b", r"\b(19|20)\d{2}\b"


def is_right_element(text: Column) -> Column:
    """Whether a cell's text looks like a date or place beside an entry, not like content."""
    low, words = F.lower(text), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    dated, placed = low.rlike(YEAR) | low.rlike(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|present|current)\b"), text.rlike(PLACE)
    veto = (text == "") | (F.length(text) > 120) | (t.sentence_ends(text) >= 2) | (t.bullets(text) >= 2) | ((words > 12) & ~dated & ~placed)
    like = low.rlike(MONTHS) | low.rlike(YEAR) | low.rlike(r"\b(present|current)\b") | low.rlike("–|—|--") | placed | ((count("[|–—,]") >= 2) & (F.length(text) < 80)) | ((words <= 8) & (t.digits(text) >= 4))
    return F.coalesce(~veto & like, F.lit(False))


def right_fraction(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 15, 0.22).when(n < 35, 0.28).otherwise(0.34)


def two_column_cells(texts: Column) -> Column:
    """Which cells of a row (array of texts) are content and right element; null if it isn't such a row."""
    tiny = lambda k: F.length(F.trim(F.get(texts, k))) < 5
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return F.when(F.size(texts) == 2, pair(0, 1)).when((F.size(texts) == 3) & tiny(0), pair(1, 2)).when((F.size(texts) == 3) & tiny(1), pair(0, 2))


def body_font(styles: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each document's body font: of the style Normal, else of Default Paragraph Font, else of the document's defaults."""
    named = lambda name, alias: F.max(F.when(F.lower("name") == name, F.nullif("font", F.lit("")))).alias(alias)
    by_style = styles.groupBy("doc_id").agg(named("normal", "a"), named("default paragraph font", "b"))
    return defaults.join(by_style, "doc_id", "left").select("doc_id", F.coalesce("a", "b", F.nullif("font", F.lit(""))).alias("font"))


def numbering(instances: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, num_id, ilvl, ordered): numbering instances with their abstract levels."""
    ordered = F.col("num_fmt").isin("decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman")
    return instances.join(levels, ["doc_id", "abstract_id"]).select("doc_id", "num_id", "ilvl", ordered.alias("ordered"))


def level_of(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """paragraphs (doc_id, num_id, ilvl) with `ordered` from numbering(); null where number or level is unknown."""
    return paragraphs.join(levels, ["doc_id", "num_id", "ilvl"], "left")


def upgraded_headings(blocks: DataFrame, suggestions: DataFrame) -> DataFrame:
    """blocks with the level of the first suggestion whose text holds, or is held by, theirs."""
    met = blocks.join(suggestions.select("doc_id", F.col("ord").alias("s_ord"), F.lower("text").alias("s_text"), F.col("level").alias("s_level")), "doc_id")
    low = F.lower("text")
    met = met.where(F.contains(low, F.col("s_text")) | F.contains(F.col("s_text"), low))
    found = met.groupBy("doc_id", "ord").agg(F.min_by("s_level", "s_ord").alias("new_level"))
    return blocks.join(found, ["doc_id", "ord"], "left").withColumn("level", F.coalesce("new_level", "level")).drop("new_level")
