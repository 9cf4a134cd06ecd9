"""Markdown and LaTeX texts: outlines, tables, equations and counts. Inputs are tables (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered_lines(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select("doc_id", (F.col("at") + 1).alias("line_number"), "line")


def _outline(lines: DataFrame, level, title, body) -> DataFrame:
    """Headings with a preview: of the next four lines those with text, as far as 100 characters are passed."""
    after = F.collect_list(F.struct(body.alias("b"))).over(Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(1, 4))
    rows = lines.withColumn("level", level).withColumn("title", F.trim(title)).withColumn("after", F.transform(after, lambda s: s["b"]))
    add = lambda acc, b: F.when((F.length(acc) > 100) | b.isNull() | (b == ""), acc).otherwise(F.concat_ws(" ", F.nullif(acc, F.lit("")), b))
    preview = F.aggregate("after", F.lit(""), add)
    return rows.where("level is not null").select("doc_id", "line_number", "level", "title", preview.alias("content_preview"))


def markdown_outline(docs: DataFrame) -> DataFrame:
    line = F.col("line")
    marks = F.length(F.regexp_extract(line, r"^(#{1,4})\s+.+$", 1))
    return _outline(numbered_lines(docs), F.when(marks > 0, marks), F.regexp_extract(line, r"^#{1,4}\s+(.+)$", 1), F.when(~line.startswith("#"), F.trim(line)))


def latex_outline(docs: DataFrame) -> DataFrame:
    line = F.col("line")
    found = lambda k: F.nullif(F.regexp_extract(line, rf"\\{'sub' * k}section\*?\{{([^}}]+)\}}", 1), F.lit(""))
    level = F.when(found(0).isNotNull(), 1).when(found(1).isNotNull(), 2).when(found(2).isNotNull(), 3)
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"\\[a-zA-Z]+\{[^}]*\}", ""), r"[\\{}]", ""))
    return _outline(numbered_lines(docs), level, F.coalesce(*[found(k) for k in range(3)]), F.when(~line.rlike(r"^\\(sub)*section"), bare))


def tabulars(docs: DataFrame, reach: int = 100) -> DataFrame:
    """LaTeX tables: line, columns of the specification, rows up to the end (within `reach` lines). Only the lines after a
    table's start are looked at, inside the document's own row."""
    begin = r"\\begin\{tabular\}\{([^}]+)\}"
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: F.get("lines", k).rlike(begin))
    at = lines.select("doc_id", "lines", F.explode(starts).alias("k"))
    at = at.select("doc_id", (F.col("k") + 1).alias("line_number"), F.regexp_extract(F.get("lines", F.col("k")), begin, 1).alias("spec"), F.slice("lines", F.col("k") + 1, reach).alias("ahead"))
    stop = F.array_position(F.transform("ahead", lambda s: F.contains(s, F.lit("\\end{tabular}"))), True)
    inside = F.when(stop > 0, F.slice("ahead", 1, (stop - 1).cast("int"))).otherwise(F.col("ahead"))
    is_row = lambda s: F.contains(s, F.lit("\\\\")) | F.contains(s, F.lit("\\hline"))
    columns = F.length(F.regexp_replace("spec", "[^lcrp]", ""))
    return at.select("doc_id", "line_number", columns.alias("column_count"), F.size(F.filter(inside, is_row)).alias("row_count"))


def equations(docs: DataFrame) -> DataFrame:
    """Display equations, with their tag's number if they have one."""
    line = F.col("line")
    tagged = F.contains(line, F.lit("\\tag{"))
    shown = F.startswith(F.trim(line), F.lit("\\[")) | F.startswith(F.trim(line), F.lit("$$"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"\\tag\{\d+\}", ""), r"\\\[|\\\]|\$\$", ""))
    rows = numbered_lines(docs).where(tagged | (shown & (bare != "")))
    return rows.select("doc_id", "line_number", tagged.alias("is_numbered"), F.nullif(F.regexp_extract(line, r"\\tag\{(\d+)\}", 1), F.lit("")).cast("int").alias("equation_number"), bare.alias("latex"))


def parameters(docs: DataFrame) -> DataFrame:
    """Counts per document: sections and their mean length, lists, references, and how headings are numbered (a tie is for
    Roman numerals)."""
    line = F.col("line")
    roman, arabic, alpha = line.rlike(r"^#{1,4}\s+(I{1,3}|IV|V|VI{0,3}|IX|X)\s"), line.rlike(r"^#{1,4}\s+\d+[.\s]"), line.rlike(r"^#{1,4}\s+[A-Z][.\s]")
    heading, numbered, bullet = line.rlike(r"^#{1,4}\s+.+$"), line.rlike(r"^\s*\d+[.)]\s"), line.rlike(r"^\s*[*\-•]\s")
    w = Window.partitionBy("doc_id").orderBy("line_number")
    rows = numbered_lines(docs).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = rows.groupBy("doc_id").agg(
        F.count_if(roman).alias("r"), F.count_if(~roman & arabic).alias("n"), F.count_if(~roman & ~arabic & alpha).alias("a"), F.count_if(heading).alias("total_sections"), F.min(F.when(heading, F.col("start"))).alias("first"),
        F.count_if(numbered).alias("numbered_list_count"), F.count_if(~numbered & bullet).alias("bullet_list_count"), F.max(F.col("start") + F.length("line")).alias("length"),
    )
    pattern = F.when(F.col("r") >= F.greatest("n", "a"), "roman").when(F.col("a") >= F.col("n"), "alpha").otherwise("arabic")
    mean = F.coalesce(F.try_divide(F.col("length") - F.col("first"), F.col("total_sections")), F.lit(0.0))
    references = F.regexp_count(F.regexp_extract("text", r"(?s)References?\n\n(.+?)(?=\n##|\z)", 1), F.lit(r"(?m)^\s*\[\d+\]"))
    return counts.join(docs.select("doc_id", references.alias("reference_count")), "doc_id").select("doc_id", pattern.alias("heading_pattern"), "total_sections", mean.alias("avg_section_length"), "numbered_list_count", "bullet_list_count", "reference_count")
