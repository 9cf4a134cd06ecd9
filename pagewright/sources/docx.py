"""Word documents: a scan of the package's XML into flat element rows, and typed tables made from these by DataFrame operations.

The scan does no more than XML needs: one row for each run, paragraph, cell, style, numbering level and so on. What they
mean (headings, lists, numbering, inheritance) is worked out on the tables, by the operators.
"""

from __future__ import annotations

import io
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import grid

ROWS = "doc_id string, kind string, scope string, ord long, parent string, text string, attrs map<string,string>"
#: The namespaces of WordprocessingML and its parts.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
WPS = "{http://schemas.microsoft.com/office/word/2010/wordprocessingShape}"
V = "{urn:schemas-microsoft-com:vml}"
SIDES = ("top", "left", "bottom", "right")
#: The elements that are counted as objects of each kind.
OBJECTS = {"textboxes": (W + "txbxContent",), "shapes": (V + "shape", WPS + "wsp"), "images": (W + "drawing",), "v_images": (V + "imagedata",)}


def _val(element, path: str, name: str = "val") -> str | None:
    found = element.find("/".join(W + p for p in path.split("/"))) if element is not None else None
    return None if found is None else found.get(W + name)


class Scan:
    """The element rows of one package."""

    def __init__(self, doc_id: str) -> None:
        self.doc_id, self.rows = doc_id, []

    def add(self, kind: str, scope: str, parent: str | None, text: str | None = None, **attrs) -> str:
        ord_ = len(self.rows)
        self.rows.append((self.doc_id, kind, scope, ord_, parent, text, {k: str(v) for k, v in attrs.items() if v is not None}))
        return str(ord_)

    def package(self, data: bytes) -> list[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            part = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
            body = part("word/document.xml")
            if body is None:
                raise ValueError(f"{self.doc_id}: no word/document.xml")
            for relation in part("word/_rels/document.xml.rels") or ():
                self.add("relation", "package", None, relation.get("Target"), id=relation.get("Id"), type=(relation.get("Type") or "").rsplit("/", 1)[-1])
            for scan, name in ((self.styles, "word/styles.xml"), (self.numbering, "word/numbering.xml"), (self.footnotes, "word/footnotes.xml")):
                root = part(name)
                if root is not None:
                    scan(root)
            tags = Counter(e.tag for e in body.iter())
            self.add("objects", "package", None, None, **{kind: sum(tags[name] for name in names) for kind, names in OBJECTS.items()})
            self.section(body)
            self.blocks(body.find(W + "body"), "body", None)
            for kind in ("header", "footer"):
                for name in sorted(n for n in names if n.startswith(f"word/{kind}") and n.endswith(".xml")):
                    for p in part(name).iter(W + "p"):
                        self.paragraph(p, kind, None)
            for name in names:
                if name.startswith("word/media/"):
                    self.add("media", "package", None, name, size=z.getinfo(name).file_size)
        return self.rows

    def section(self, root) -> None:
        found = next(root.iter(W + "sectPr"), None)
        if found is not None:
            self.add("section", "body", None, None, **{k: _val(found, p, n) for k, p, n in (
                ("page_width", "pgSz", "w"), ("page_height", "pgSz", "h"), ("top", "pgMar", "top"), ("bottom", "pgMar", "bottom"), ("left", "pgMar", "left"), ("right", "pgMar", "right"), ("columns", "cols", "num"), ("column_space", "cols", "space"),
            )})

    def styles(self, root) -> None:
        defaults = root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")
        if defaults is not None:
            self.add("defaults", "styles", None, None, **self.run_style(defaults))
        for s in root.iter(W + "style"):
            size = _val(s, "rPr/sz")
            self.add("style", "styles", None, _val(s, "name"), id=s.get(W + "styleId"), based_on=_val(s, "basedOn"), outline_level=_val(s, "pPr/outlineLvl"), before=_val(s, "pPr/spacing", "before"), after=_val(s, "pPr/spacing", "after"), size=size, font=_val(s, "rPr/rFonts", "ascii") or _val(s, "rPr/rFonts", "hAnsi"))

    def numbering(self, root) -> None:
        for abstract in root.iter(W + "abstractNum"):
            for level in abstract.iter(W + "lvl"):
                self.add("level", "numbering", abstract.get(W + "abstractNumId"), _val(level, "lvlText"), ilvl=level.get(W + "ilvl"), num_fmt=_val(level, "numFmt"), start=_val(level, "start"))
        for num in root.findall(W + "num"):
            self.add("instance", "numbering", _val(num, "abstractNumId"), None, num_id=num.get(W + "numId"))

    def footnotes(self, root) -> None:
        for note in root.iter(W + "footnote"):
            text = "".join("".join(t.text or "" for t in p.iter(W + "t")) + " " for p in note.iter(W + "p"))
            self.add("footnote", "footnotes", None, text, id=note.get(W + "id"))

    def blocks(self, parent, scope: str, owner: str | None) -> None:
        for e in parent if parent is not None else ():
            if e.tag == W + "p":
                self.paragraph(e, scope, owner)
            elif e.tag == W + "tbl":
                self.table(e, scope, owner)
            elif e.tag == W + "sdt":
                self.blocks(e.find(W + "sdtContent"), scope, owner)

    def paragraph(self, p, scope: str, owner: str | None) -> None:
        pr = p.find(W + "pPr")
        here = self.add(
            "paragraph", scope, owner, None, style=_val(pr, "pStyle"), num_id=_val(pr, "numPr/numId"), ilvl=_val(pr, "numPr/ilvl"), justification=_val(pr, "jc"), before=_val(pr, "spacing", "before"), after=_val(pr, "spacing", "after"),
            line=_val(pr, "spacing", "line"), line_rule=_val(pr, "spacing", "lineRule"), tabs=",".join(f"{t.get(W + 'pos')}:{t.get(W + 'val')}" for t in pr.iter(W + "tab")) if pr is not None else None,
        )
        self.runs(p, scope, here, None)

    def runs(self, parent, scope: str, owner: str, url: str | None) -> None:
        for e in parent if parent is not None else ():
            if e.tag == W + "r":
                self.run(e, scope, owner, url)
            elif e.tag == W + "hyperlink":
                self.runs(e, scope, owner, e.get(R + "id") or url)
            elif e.tag == W + "sdt":
                self.runs(e.find(W + "sdtContent"), scope, owner, url)
            elif e.tag == MC + "AlternateContent":
                choice = e.find(MC + "Choice")
                self.runs(choice if choice is not None else e.find(MC + "Fallback"), scope, owner, url)
            elif e.tag == W + "drawing":
                self.drawing(e, scope, owner)

    @staticmethod
    def run_style(pr) -> dict:
        fonts = pr.find(W + "rFonts") if pr is not None else None
        font = next((f for f in (fonts.get(W + k) for k in ("ascii", "hAnsi", "cs")) if f), None) if fonts is not None else None
        on = lambda tag: pr is not None and pr.find(W + tag) is not None  # noqa: E731  presence counts, whatever its value
        return {"bold": on("b"), "italic": on("i"), "underline": on("u"), "font": font, "size": _val(pr, "sz") or _val(pr, "szCs"), "run_style": _val(pr, "rStyle")}

    def run(self, r, scope: str, owner: str, url: str | None) -> None:
        style = self.run_style(r.find(W + "rPr"))
        for e in r:
            if e.tag == W + "t":
                self.add("span", scope, owner, e.text or "", url=url, **style)
            elif e.tag == W + "tab":
                self.add("span", scope, owner, "\t", tab=True, **style)
            elif e.tag == W + "br":
                self.add("span", scope, owner, "\n", **style)
            elif e.tag == W + "footnoteReference":
                self.add("span", scope, owner, "", footnote=e.get(W + "id"), **style)
            elif e.tag in (W + "drawing", W + "object", W + "pict"):
                self.drawing(e, scope, owner)
            elif e.tag == MC + "AlternateContent":
                self.runs(e, scope, owner, url)

    def drawing(self, e, scope: str, owner: str) -> None:
        anchor = e.find(WP + "anchor")
        holder = anchor if anchor is not None else e.find(WP + "inline")
        if holder is None:
            return
        extent = holder.find(WP + "extent")
        size = {"cx": extent.get("cx"), "cy": extent.get("cy")} if extent is not None else {}
        at = {"x": holder.findtext(f"{WP}positionH/{WP}posOffset"), "y": holder.findtext(f"{WP}positionV/{WP}posOffset")}
        picture, box = next(holder.iter(A + "blip"), None), next(holder.iter(W + "txbxContent"), None)
        if picture is not None:
            self.add("figure", scope, owner, None, embed=picture.get(R + "embed"), floating=anchor is not None, **size, **at)
        elif box is not None and anchor is not None:
            here = self.add("textbox", scope, owner, None, **size, **at)
            self.blocks(box, "textbox", here)

    @staticmethod
    def margins(pr, tag: str) -> dict:
        """Widths of the four sides as far as they are given."""
        return {f"margin_{side}": _val(pr, f"{tag}/{side}", "w") for side in SIDES}

    def table(self, table, scope: str, owner: str | None) -> None:
        pr = table.find(W + "tblPr")
        borders = pr.find(W + "tblBorders") if pr is not None else None
        visible = borders is not None and any(b.get(W + "val") not in (None, "", "nil", "none") for b in borders)
        widths = [int(g.get(W + "w") or 0) for g in table.findall(f"{W}tblGrid/{W}gridCol")]
        kind, width = _val(pr, "tblW", "type") or "dxa", _val(pr, "tblW", "w") or "0"
        own = int(width) if kind == "dxa" and width.isdigit() else int(int(width) / 5000 * 9360) if kind == "pct" and width.isdigit() else 0
        here = self.add("table", scope, owner, None, has_borders=visible, width=own or sum(widths), widths=",".join(map(str, widths)), **self.margins(pr, "tblCellMar"))
        for i, row in enumerate(table.findall(W + "tr")):
            height, before = row.find(f"{W}trPr/{W}trHeight"), _val(row.find(W + "trPr"), "gridBefore")
            self.add("row", scope, here, None, row_idx=i, height=height.get(W + "val") if height is not None else None, rule=height.get(W + "hRule") if height is not None else None)
            for j, cell in enumerate(row.findall(W + "tc")):
                tc = cell.find(W + "tcPr")
                merge = tc.find(W + "vMerge") if tc is not None else None
                text = "\n".join("".join(t.text or "" for t in p.iter(W + "t")) for p in cell.findall(W + "p"))
                heading = any("heading" in (_val(p, "pPr/pStyle") or "").lower() for p in cell.findall(W + "p"))
                place = self.add("cell", scope, here, text, row_idx=i, cell_idx=j, col_span=_val(tc, "gridSpan") or 1, grid_before=before, **self.margins(tc, "tcMar"), v_merge=merge is not None, v_restart=merge is not None and merge.get(W + "val") == "restart", v_align=_val(tc, "vAlign"), heading_style=heading)
                self.blocks(cell, "cell", place)


def scan(files: DataFrame) -> DataFrame:
    """Element rows of the packages in a binaryFile table (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(Scan(path).package(bytes(content)), columns=["doc_id", "kind", "scope", "ord", "parent", "text", "attrs"])

    return files.select("path", "content").mapInPandas(run, ROWS)


def media(files: DataFrame) -> DataFrame:
    """(doc_id, path, content): the media files inside the packages of a binaryFile table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        if name.startswith("word/media/") and not name.endswith("/"):
                            yield pd.DataFrame([(path, name.removeprefix("word/"), z.read(name))], columns=["doc_id", "path", "content"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, path string, content binary")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The typed tables of the documents under a path."""
    return tables(scan(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Typed tables from element rows: blocks, spans, cells, tables, rows, styles, defaults, levels, instances, relations,
    footnotes, figures, sections, media, objects (counts of text boxes, shapes and images)."""
    a = lambda name, kind="string": F.col("attrs")[name].cast(kind).alias(name)
    of = lambda kind, *columns: rows.where(F.col("kind") == kind).select("doc_id", *columns)
    owner = F.col("parent").cast("long")
    emu = lambda name, alias: (F.col("attrs")[name].cast("double") / 914400).alias(alias)
    points = lambda name, alias: (F.col("attrs")[name].cast("double") / 20).alias(alias)
    inches = lambda name, default: F.coalesce(F.col("attrs")[name].cast("double") / 1440, F.lit(default)).alias(name)
    whole = lambda name, default: F.coalesce(F.expr(f"try_cast(attrs['{name}'] as int)"), F.lit(default)).alias(name)
    margins = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, SIDES)), F.array(*[F.expr(f"try_cast(attrs['margin_{s}'] as int)") for s in SIDES])), lambda _, v: v.isNotNull())
    return {
        "blocks": of("paragraph", "scope", "ord", owner.alias("parent"), a("style"), a("num_id", "int"), a("ilvl", "int"), a("justification"), points("before", "spacing_before"), points("after", "spacing_after"), a("tabs")),
        "spans": of("span", "scope", "ord", owner.alias("block"), "text", a("bold", "boolean"), a("italic", "boolean"), a("underline", "boolean"), a("font"), (F.col("attrs")["size"].cast("double") / 2).alias("font_size"), F.coalesce(F.col("attrs")["tab"].cast("boolean"), F.lit(False)).alias("is_tab"), a("url"), a("footnote")),
        "tables": of("table", "scope", F.col("ord").alias("table_id"), a("has_borders", "boolean"), a("width", "int"), a("widths"), margins.alias("margins")),
        "rows": of("row", owner.alias("table_id"), a("row_idx", "int"), a("height", "int"), a("rule")),
        "cells": of("cell", owner.alias("table_id"), F.col("ord").alias("cell_id"), a("row_idx", "int"), a("cell_idx", "int"), whole("col_span", 1), whole("grid_before", 0), margins.alias("margins"), a("v_merge", "boolean"), a("v_restart", "boolean"), F.when(F.col("attrs")["v_restart"].cast("boolean"), 2).otherwise(1).alias("row_span"), a("v_align"), a("heading_style", "boolean"), "text"),
        "styles": of("style", a("id").alias("style_id"), F.col("text").alias("name"), a("based_on"), a("outline_level", "int"), points("before", "spacing_before"), points("after", "spacing_after"), (F.col("attrs")["size"].cast("double") / 2).alias("font_size"), a("font")),
        "defaults": of("defaults", a("font"), (F.col("attrs")["size"].cast("double") / 2).alias("font_size")),
        "levels": of("level", F.col("parent").alias("abstract_id"), a("ilvl", "int"), a("num_fmt"), a("start", "int"), F.col("text").alias("level_text")),
        "instances": of("instance", F.col("parent").alias("abstract_id"), a("num_id", "int")),
        "relations": of("relation", a("id"), a("type"), F.col("text").alias("target")),
        "footnotes": of("footnote", a("id"), "text").where(F.expr("try_cast(id as int) is null or try_cast(id as int) > 0")),
        "figures": of("figure", "scope", "ord", owner.alias("block"), a("embed"), a("floating", "boolean"), emu("cx", "width"), emu("cy", "height"), emu("x", "x"), emu("y", "y")),
        "textboxes": of("textbox", "scope", "ord", owner.alias("block"), emu("cx", "width"), emu("cy", "height"), emu("x", "x"), emu("y", "y")),
        "sections": of("section", inches("page_width", 8.5), inches("page_height", 11.0), inches("top", 1.0), inches("bottom", 1.0), inches("left", 1.0), inches("right", 1.0), F.coalesce(F.col("attrs")["columns"].cast("int"), F.lit(1)).alias("columns"), F.coalesce(F.col("attrs")["column_space"].cast("double") / 20, F.lit(36.0)).alias("column_space")),
        "media": of("media", F.col("text").alias("path"), a("size", "long")),
        "objects": of("objects", *[a(kind, "long") for kind in OBJECTS]),
    }


def grids(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """From `tables`' result: grid_cells, one row for each cell or group of merged cells (its place, spans, width and height in twips, alignment, margins: the
    cell's own ones, for the other sides the table's), and grid_blocks, the paragraphs inside these, in order. Heights are sums over the rows of a
    merged cell, null if none of these has one."""
    by = ["doc_id", "table_id"]
    cells = grid.placed(found["cells"].withColumn("v_align", grid.alignment(F.col("v_align"))), by, F.col("grid_before"))
    merged = grid.rectangles(cells.drop("row_span", "grid_before"), by).join(found["tables"].select(*by, "widths", F.col("margins").alias("__margins")), by)
    merged = grid.sized(merged, F.when(F.coalesce("widths", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("widths", ","))).drop("widths")
    own = F.col("margins")
    merged = merged.withColumn("margins", F.map_concat(F.map_filter("__margins", lambda k, _: ~F.map_contains_key(own, k)), own)).drop("__margins")
    heights = found["rows"].select(*by, F.col("row_idx").alias("__row"), "height")
    spanned = merged.select(*by, "row_idx", "grid_col", F.explode(F.sequence(F.col("row_idx"), F.col("row_idx") + F.col("row_span") - 1)).alias("__row")).join(heights, [*by, "__row"])
    merged = merged.join(spanned.groupBy(*by, "row_idx", "grid_col").agg(F.sum("height").alias("height")), [*by, "row_idx", "grid_col"], "left")
    paragraphs = found["blocks"].where("scope = 'cell'").drop("scope")
    return {"grid_cells": merged, "grid_blocks": grid.cell_paragraphs(merged, paragraphs, by)}
