"""LaTeX from blocks and spans: one string per block by Column expressions, joined in order per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import caption_escape, latex_escape

#: Substrings of font names, in order, and the fonts that stand for them.
FONTS = (("calibri", "TeX Gyre Heros"), ("courier|mono", "TeX Gyre Cursor"), ("helvetica|arial|sans", "TeX Gyre Heros"), ("times|serif", "TeX Gyre Termes"), ("verdana|tahoma|trebuchet", "TeX Gyre Heros"))
ALIGNMENTS = {"center": "center", "right": "flushright", "end": "flushright", "left": "flushleft", "start": "flushleft"}


def font(name: Column) -> Column:
    out = F.when(F.coalesce(F.trim(name), F.lit("")) == "", "TeX Gyre Heros")
    for pattern, stand_in in FONTS:
        out = out.when(F.lower(name).rlike(pattern), stand_in)
    return out.otherwise(name)


def font_command(name: Column) -> Column:
    """The document's main font."""
    return F.concat(F.lit("\\setmainfont{"), font(name), F.lit("}"))


def font_wrapper(family: Column, size: Column, spacing: Column, spacing_type: Column, base: Column) -> tuple[Column, Column]:
    """What stands before and after a block with a font of its own: a family other than the base font's, a size with its baseline (exact
    spacing, a multiple of the size, or 1.2 times). Two empty strings for a block without."""
    own, known = font(family), font(base)
    inline = F.when((F.coalesce(family, F.lit("")) != "") & ~own.eqNullSafe(known), F.concat(F.lit("\\fontspec{"), own, F.lit("}")))
    exact, times = spacing_type.isin("exact", "atLeast") & (spacing > 0), (F.coalesce(spacing_type, F.lit("multiplier")) == "multiplier") & (spacing > 0)
    baseline = F.when(exact, spacing).when(times, size * spacing).otherwise(size * 1.2)
    sized = F.when(size > 0, F.concat(F.lit("\\fontsize{"), F.format_string("%.1f", size), F.lit("}{"), F.format_string("%.1f", baseline), F.lit("}\\selectfont")))
    commands = F.concat_ws(" ", inline, sized)
    return F.when(commands != "", F.concat(F.lit("{"), commands, F.lit(" "))).otherwise(""), F.when(commands != "", "}").otherwise("")


def heading_size(sizes: Column, level: Column, default: Column) -> tuple[Column, Column]:
    """Size and baseline of headings of a level, from a map of sizes by level, else a default."""
    found = F.try_element_at(sizes, level)
    size = F.when(found > 0, found).otherwise(default)
    return size, size * 1.2


def running_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, scope, tex): headers and footers, their blocks (doc_id, scope, ord, tex, justification) aligned and joined in order; empty
    blocks are left out."""
    kept = blocks.where(F.col("scope").isin("header", "footer") & (F.coalesce("tex", F.lit("")) != "")).withColumn("tex", aligned(F.col("justification"), F.col("tex")))
    return kept.groupBy("doc_id", "scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tex"))), lambda s: s["tex"]), "\n\n").alias("tex"))


def header_overlay(texts: Column) -> Column:
    """Header texts as one line for an overlay."""
    return F.array_join(F.transform(F.filter(texts, lambda s: F.coalesce(s, F.lit("")) != ""), latex_escape), " \\\\ ")


def spans(content: Column) -> Column:
    """Styled text from an array of structs (text, bold, italic, underline)."""

    def one(s: Column) -> Column:
        out = latex_escape(s["text"])
        for flag, command in (("italic", "textit"), ("bold", "textbf"), ("underline", "underline")):
            out = F.when(F.coalesce(s[flag], F.lit(False)) & (F.trim(s["text"]) != ""), F.concat(F.lit(f"\\{command}{{"), out, F.lit("}"))).otherwise(out)
        return out

    return F.array_join(F.transform(content, one), "")


def heading(level: Column, text: Column) -> Column:
    command = F.when(level <= 1, "\\section*{").when(level == 2, "\\subsection*{").otherwise("\\subsubsection*{")
    return F.concat(command, text, F.lit("}"))


def aligned(justification: Column, text: Column) -> Column:
    environment = F.when(F.lit(False), "")
    for word, env in ALIGNMENTS.items():
        environment = environment.when(justification == word, env)
    return F.when(environment.isNull(), text).otherwise(F.concat(F.lit("\\begin{"), environment, F.lit("}\n"), text, F.lit("\n\\end{"), environment, F.lit("}")))


def item_list(ordered: Column, items: Column) -> Column:
    env = F.when(ordered, "enumerate").otherwise("itemize")
    lines = F.array_join(F.transform(items, lambda i: F.concat(F.lit("  \\item "), i)), "\n")
    return F.concat(F.lit("\\begin{"), env, F.lit("}\n"), lines, F.lit("\n\\end{"), env, F.lit("}"))


def tables(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, tex) from cells: rows are padded to the widest, spans become \\multicolumn."""
    text = latex_escape(F.regexp_replace("text", "\n", " "))
    cell = F.when(F.col("col_span") > 1, F.concat(F.lit("\\multicolumn{"), F.col("col_span").cast("string"), F.lit("}{l}{"), text, F.lit("}"))).otherwise(text)
    rows = cells.withColumn("tex", cell).groupBy("doc_id", "table_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "tex"))), lambda s: s["tex"]).alias("cells"), F.sum("col_span").cast("int").alias("width"))
    whole = rows.groupBy("doc_id", "table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells", "width"))).alias("rows"), F.max("width").alias("n"))
    line = lambda r: F.concat(F.array_join(F.concat(r["cells"], F.array_repeat(F.lit(""), F.col("n") - r["width"])), " & "), F.lit(" \\\\ \\hline"))
    body = F.array_join(F.transform("rows", line), "\n")
    return whole.select("doc_id", "table_id", F.concat(F.lit("\\begin{tabularx}{\\linewidth}{|"), F.repeat(F.lit("X|"), F.col("n")), F.lit("}\n\\hline\n"), body, F.lit("\n\\end{tabularx}")).alias("tex"))


def figure(path: Column, width: Column, caption: Column) -> Column:
    size = F.when(width.isNotNull(), F.format_string("width=%.2fin", width)).otherwise("width=\\linewidth")
    note = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("\n\\caption{"), caption_escape(caption), F.lit("}"))).otherwise("")
    return F.concat(F.lit("\\begin{figure}[H]\n\\centering\n\\includegraphics["), size, F.lit("]{"), path, F.lit("}"), note, F.lit("\n\\end{figure}"))


def preamble(features: DataFrame) -> DataFrame:
    """(doc_id, preamble): packages by what a document holds. features: the flags of documents.feature_flags and page
    sizes in inches, font and line spacing."""
    use = lambda name: F.lit(f"\\usepackage{{{name}}}")
    when = lambda flag, *lines: [F.when(F.col(flag), line if isinstance(line, Column) else F.lit(line)) for line in lines]
    sized = lambda name, column: F.format_string(f"{name}=%sin", F.col(column).cast("string"))
    lines = [
        F.lit("\\documentclass{article}"), *[use(p) for p in ("fontspec", "geometry", "setspace", "titlesec", "enumitem", "graphicx", "caption")],
        *when("has_urls", "\\usepackage[hidelinks]{hyperref}", "\\usepackage{xcolor}"), *when("needs_ltablex", "\\usepackage{ltablex}", "\\keepXColumns"),
        F.when(F.col("has_tables") & ~F.col("needs_ltablex"), use("tabularx")), F.when(F.col("has_tables") | F.col("needs_ltablex"), use("array")), *when("has_figures", "\\usepackage{float}"),
        *when("has_floats", "\\usepackage[absolute,overlay]{textpos}", "\\setlength{\\TPHorizModule}{1in}", "\\setlength{\\TPVertModule}{1in}"), use("multicol"), use("ragged2e"), use("tabto"),
        font_command(F.col("font")),
        F.concat(F.lit("\\geometry{"), F.concat_ws(",", sized("paperwidth", "page_width"), sized("paperheight", "page_height"), sized("top", "top"), sized("bottom", "bottom"), sized("left", "left"), sized("right", "right")), F.lit("}")),
        F.format_string("\\setstretch{%.2f}", F.col("line_spacing")), F.lit("\\setlength{\\parindent}{0pt}"), F.lit("\\setlength{\\parskip}{0pt}"), F.lit("\\pagenumbering{gobble}"),
    ]
    return features.select("doc_id", F.concat_ws("\n", *lines).alias("preamble"))


def documents(blocks: DataFrame, preambles: DataFrame) -> DataFrame:
    """(doc_id, tex): each document's blocks (doc_id, ord, tex) in order, after its preamble."""
    body = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tex"))), lambda s: s["tex"]), "\n\n").alias("body"))
    tex = F.concat(F.col("preamble"), F.lit("\n\\begin{document}\n"), F.coalesce("body", F.lit("")), F.lit("\n\\end{document}\n"))
    return preambles.join(body, "doc_id", "left").select("doc_id", tex.alias("tex"))


#: Characters that pdfLaTeX can't read, in the order of their replacement.
UNREADABLE = (("\u2013", "--"), ("\u2014", "---"), ("\u2018", "`"), ("\u2019", "'"), ("\u201c", "``"), ("\u201d", "''"), ("\u2022", "\\textbullet{}"), ("\u2026", "\\ldots{}"), ("\u00a0", "~"))


def readable(tex: Column) -> Column:
    for char, command in UNREADABLE:
        tex = F.replace(tex, F.lit(char), F.lit(command))
    return tex
