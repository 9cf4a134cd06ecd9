"""Word documents to LaTeX: the whole conversion as one plan over the tables of sources.docx."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import latex_escape
from pagewright.operators import documents as d
from pagewright.operators import structure
from pagewright.sinks import latex
from pagewright.sources import docx


def blocks(t: dict[str, DataFrame]) -> DataFrame:
    """Body blocks with their kind, level, content (array of spans) and list membership."""
    body = t["blocks"].where("scope = 'body' and parent is null")
    spans = t["spans"].where("scope = 'body'").groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "bold", "italic", "underline"))).alias("content"))
    styles = t["styles"].select("doc_id", F.col("style_id").alias("style"), "name", "outline_level")
    met = body.join(spans.withColumnRenamed("block", "ord"), ["doc_id", "ord"], "left").join(styles, ["doc_id", "style"], "left")
    text = F.array_join(F.transform("content", lambda s: s["text"]), "")
    met = met.withColumn("text", F.coalesce(text, F.lit("")))
    by_style = structure.heading_level(F.col("style"), F.col("name"), F.col("outline_level"))
    by_content = F.when(structure.is_content_heading(F.col("text"), F.coalesce(F.forall("content", lambda s: F.coalesce(s["bold"], F.lit(False))), F.lit(False))), 1)
    met = met.withColumn("level", F.coalesce(by_style, by_content))
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("num_id").isNotNull(), "list").otherwise("paragraph")
    return met.withColumn("block_type", kind)


def to_latex(t: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, tex) from the typed tables of some documents."""
    found = blocks(t)
    content = latex.spans(F.col("content"))
    plain = found.where("block_type <> 'list' and text <> ''")
    tex = F.when(F.col("block_type") == "heading", latex.heading(F.col("level"), latex_escape(F.trim("text")))).otherwise(latex.aligned(F.col("justification"), content))
    parts = plain.select("doc_id", "ord", tex.alias("tex"))
    ordered = structure.numbering(t["instances"], t["levels"])
    lists = found.join(ordered, ["doc_id", "num_id", "ilvl"], "left").withColumn("ordered", F.coalesce("ordered", F.lit(False)))
    items = lists.select("doc_id", "ord", F.when(F.col("block_type") == "list", F.col("num_id")).alias("num_id"), F.coalesce(content, F.lit("")).alias("content"), "ordered")
    runs = d.list_runs(items)
    parts = parts.unionByName(runs.select("doc_id", "ord", latex.item_list(F.col("ordered"), F.transform("items", lambda i: i["content"])).alias("tex")))
    tables = latex.tables(t["cells"]).select("doc_id", F.col("table_id").alias("ord"), "tex")
    figures = t["figures"].where("scope = 'body'").join(t["relations"].select("doc_id", F.col("id").alias("embed"), "target"), ["doc_id", "embed"], "left")
    parts = parts.unionByName(tables).unionByName(figures.select("doc_id", "ord", latex.figure(F.coalesce("target", F.lit("missing")), F.col("width"), F.lit(None).cast("string")).alias("tex")))
    flag = lambda df, name: df.groupBy("doc_id").agg(F.lit(True).alias(name))
    ids = t["blocks"].select("doc_id").distinct()
    features = ids.join(t["sections"], "doc_id", "left").join(structure.body_font(t["styles"], ids.join(t["defaults"], "doc_id", "left")), "doc_id", "left")
    for df, name in ((t["tables"], "has_tables"), (t["figures"], "has_figures"), (t["spans"].where("url is not null"), "has_urls"), (t["figures"].where("floating"), "has_floats"), (t["rows"].where("row_idx >= 8"), "needs_ltablex")):
        features = features.join(flag(df, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    defaults = {"page_width": 8.5, "page_height": 11.0, "top": 1.0, "bottom": 1.0, "left": 1.0, "right": 1.0}
    return latex.documents(parts, latex.preamble(features.na.fill(defaults).withColumn("line_spacing", F.lit(1.0))))


def convert(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tex) of the documents under a path."""
    return to_latex(docx.read(spark, path))
