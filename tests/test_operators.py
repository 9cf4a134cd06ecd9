"""Operators on small tables, with their edge rows."""

import difflib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.operators import documents, drift, layout, matching, structure
from pagewright.sinks import labels as label_sinks
from pagewright.sinks import latex, reports
from pagewright.sources import docx, labels, markup
from pagewright.streaming import cooldown


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_greedy_takes_first_of_equals(spark):
    pairs = spark.createDataFrame([("d", 0, 1, 0.9), ("d", 0, 0, 0.9), ("d", 1, 0, 0.95), ("d", 1, 2, 0.5), ("e", 0, 7, 0.5)], "doc_id string, ref_ord long, gen_ord long, score double")
    assert rows(matching.greedy(pairs), "doc_id", "ref_ord") == [("d", 0, 0, 0.9), ("d", 1, 2, 0.5), ("e", 0, 7, 0.5)]


def test_vision_candidates_bounds(spark):
    schema = "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
    ref = spark.createDataFrame([("d", 0, 0, "a b", 0.0, 0.0, 1.0, 1.0)], schema)
    gen = spark.createDataFrame([("d", p, p, "a b", 0.0, 0.0, 1.0, 1.0) for p in range(4)] + [("d", 0, 9, "z", 0.0, 0.0, 1.0, 1.0)], schema)
    assert [(r.gen_ord, round(r.score, 6)) for r in matching.vision_candidates(ref, gen).orderBy("gen_ord").collect()] == [(0, 1.0), (1, 0.9)]


def test_outline_pairs(spark):
    ref = spark.createDataFrame([("d", 0, "1. Introduction"), ("d", 1, "Results")], "doc_id string, ord int, title string")
    gen = spark.createDataFrame([("d", 0, "Introduction"), ("d", 1, "Unlike")], "doc_id string, ord int, title string")
    assert [(r.ref_ord, r.gen_ord) for r in matching.outline_pairs(ref, gen).collect()] == [(0, 0)]


def test_alignment_and_headings(spark):
    a, b = spark.createDataFrame([("d", 1, 5)], "doc_id string, page int, n int"), spark.createDataFrame([("d", 2, 6)], "doc_id string, page int, n int")
    assert rows(matching.align(a, b, ["doc_id", "page"], "n", 0), "page") == [("d", 1, 5, 0, True, False), ("d", 2, 0, 6, False, True)]
    heads = spark.createDataFrame([("d", 0, "A", 0, 0.1), ("d", 1, "B", 0, 0.5), ("d", 2, "C", 0, 0.9)], "doc_id string, ord int, title string, page int, y0 double")
    gen = spark.createDataFrame([("d", "A", 0, 0.9), ("d", "A", 0, 0.2), ("d", "B", 3, 0.1), ("d", "B", 2, 0.7)], "doc_id string, text string, page int, y0 double")
    assert [(r.status, r.gen_page, r.gen_y) for r in matching.nearest_heading(heads, gen).orderBy("ord").collect()] == [("FOUND", 0, 0.2), ("PAGE_MOVED", 2, 0.7), ("MISSING", None, None)]


def test_layout(spark):
    xs = spark.createDataFrame([("p", x) for x in (1, 2, 3, 50, 52, 54)], "page string, x long")
    split = layout.two_means(xs, ["page"]).first()
    assert (split.nl, split.left_max, split.right_min) == (3, 3, 50)
    boundaries = F.array(F.lit(0.5))
    assert [r.v for r in spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "x double").select(layout.column_index(F.col("x"), boundaries).alias("v")).collect()] == [0, 1, 1]
    spans = spark.createDataFrame([("p", a, b) for a, b in ((0.0, 0.42), (0.55, 1.0))] * 4, "page string, x0 double, x1 double")
    runs = layout.low_coverage_runs(spans, ["page"], bins=100)
    assert rows(runs.select("first_bin", "last_bin", "n_bins"), "first_bin") == [(42, 54, 13)]
    open_end = spark.createDataFrame([("p", 0.0, 0.6)] * 4, "page string, x0 double, x1 double")
    assert layout.low_coverage_runs(open_end, ["page"], bins=100).count() == 0
    blocks = spark.createDataFrame([("p", 0.0, 0.4)] * 3 + [("p", 0.6, 0.9)] * 3 + [("q", 0.0, 0.4)] * 3, "page string, x0 double, x1 double")
    assert rows(layout.column_vote(blocks, ["page"]).select("page", "columns"), "page") == [("p", 2), ("q", 1)]


def test_islands_and_lists(spark):
    schema = "doc_id string, ord int, num_id int, content string, ordered boolean"
    blocks = spark.createDataFrame([("d", 0, 1, "a", True), ("d", 1, 1, "", True), ("d", 2, 1, "b", False), ("d", 3, None, "text", False), ("d", 4, 1, "c", True), ("d", 5, 2, "d", False)], schema)
    assert [(r.ord, [i["content"] for i in r["items"]], r.ordered) for r in documents.list_runs(blocks).orderBy("ord").collect()] == [(0, ["a", "b"], True), (4, ["c"], True), (5, ["d"], False)]
    spans = spark.createDataFrame([("d", 0, 0, "a", True, False), ("d", 0, 1, "b", True, False), ("d", 0, 2, "\t", True, True), ("d", 0, 3, "c", False, False)], "doc_id string, block_id int, ord int, text string, bold boolean, is_tab boolean")
    assert [r.text for r in documents.joined_spans(spans, ["bold"]).orderBy("ord").collect()] == ["ab", "\t", "c"]


def test_inheritance_ends_in_cycles(spark):
    styles = spark.createDataFrame([("d", "a", "b", None), ("d", "b", "c", None), ("d", "c", None, 12.0), ("d", "x", "y", None), ("d", "y", "x", None)], "doc_id string, style_id string, based_on string, size double")
    assert rows(documents.inherited(styles, "size"), "style_id") == [("d", "a", 12.0), ("d", "b", 12.0), ("d", "c", 12.0), ("d", "x", None), ("d", "y", None)]


def test_gates(spark):
    schema = "doc_id string, label string, count_scored long, hit_boundary long, blank_gen long, missing_page long, median_dx double, median_dy double, coverage double"
    stats = spark.createDataFrame([("d", "figure", 5, 0, 1, 0, None, None, 1.0), ("d", "title", 0, 0, 0, 0, None, None, 0.0), ("e", "odd", 9, 0, 0, 0, 1.0, -7.0, 0.9)], schema)
    defaults = spark.createDataFrame([("title", "median_abs_dy_max", 5.0), ("figure", "min_regions", 1.0)], "label string, param string, value double")
    own = spark.createDataFrame([("e", "odd", "median_abs_dx_max", 0.5)], "doc_id string, label string, param string, value double")
    labels_ = drift.gate_labels(stats, drift.overlay(defaults, own, stats.select("doc_id", "label")))
    assert rows(labels_, "doc_id", "label") == [("d", "figure", "FAIL", ["blank_gen"]), ("d", "title", "SKIP", ["regions"]), ("e", "odd", "FAIL", ["median_dy", "median_dx"])]
    pages = spark.createDataFrame([("d", 1, 1), ("e", 2, 2), ("f", 1, 4), ("g", 1, 2), ("h", 3, 3)], "doc_id string, ref_pages int, gen_pages int")
    assert [r.warn_class for r in drift.gate_documents(labels_, pages).orderBy("doc_id").collect()] == ["WARN_STRUCTURE_DRIFT", "WARN_STRUCTURAL_LAYOUT_MISMATCH", "WARN_CATASTROPHIC_LAYOUT", "WARN_PAGE_COUNT", None]


def test_policies(spark):
    cells = spark.createDataFrame([("t", 0, 2, 2), ("t", 0, 1, 1), ("t", 1, 1, 1)], "table_id string, row_idx int, col_span int, row_span int")
    assert documents.table_complexity(cells, ["table_id"]).first().complexity == 2 and documents.parser_complexity(cells, ["table_id"]).first().complexity == 4
    blocks = spark.createDataFrame([("d", 0), ("e", 0), ("f", 0)], "doc_id string, page int")
    regions = spark.createDataFrame([("d", 0, 0, "table", "heuristic", 1.0), ("d", 0, 1, "Table", "ml", 0.9), ("e", 0, 0, "textbox", "ml", 0.1)], "doc_id string, page int, ord int, label string, source string, confidence double")
    assert [r.decision for r in documents.region_policy(blocks, regions).orderBy("doc_id").collect()] == ["fallback", "semantic", "semantic"]
    assert rows(documents.cascade(spark.createDataFrame([("d", 1)], "doc_id string, x int"), spark.createDataFrame([("d", 2), ("e", 3)], "doc_id string, x int")), "doc_id") == [("d", 1), ("e", 3)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCUMENT = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:rPr><w:b w:val="0"/><w:sz w:val="22"/></w:rPr><w:t>item</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p>
<w:sdt><w:sdtContent><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:sdtContent></w:sdt>
<w:tbl><w:tblPr><w:tblW w:w="9000" w:type="dxa"/></w:tblPr><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>SKILLS</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>text one</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>
<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:cols w:num="2"/></w:sectPr></w:body></w:document>"""
STYLES = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="N"/></w:style><w:style w:styleId="N"><w:name w:val="Normal"/><w:rPr><w:sz w:val="20"/></w:rPr></w:style></w:styles>'
NUMBERING = f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
NOTES = f'<w:footnotes {W}><w:footnote w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'


def test_docx(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in (("word/document.xml", DOCUMENT), ("word/styles.xml", STYLES), ("word/numbering.xml", NUMBERING), ("word/footnotes.xml", NOTES)):
            z.writestr(name, content)
        z.writestr("word/media/image1.png", b"\x89PNG\x00")
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    t = docx.read(spark, str(tmp_path))
    held = docx.media(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert (held.path, bytes(held.content)) == ("media/image1.png", b"\x89PNG\x00") and t["media"].first()["size"] == 5
    objects = t["objects"].first()
    assert (objects.images, objects.textboxes, objects.shapes, objects.v_images) == (DOCUMENT.count("<w:drawing>"), DOCUMENT.count("<w:txbxContent>"), DOCUMENT.count("<v:shape"), DOCUMENT.count("<v:imagedata"))
    assert [r.text for r in t["spans"].where("scope = 'body'").orderBy("ord").collect()] == ["Title", "item", "", "inside"]
    assert t["spans"].where("text = 'item'").first().bold and t["spans"].where("text = 'item'").first().font_size == 11
    assert structure.numbering(t["instances"], t["levels"]).select("num_id", "ilvl", "ordered").first() == (3, 0, True)
    assert [r.text for r in t["footnotes"].collect()] == ["note "]
    section = t["sections"].first()
    assert (section.page_width, section.columns, section.top) == (8.5, 2, 1.0)
    found = structure.layout_tables(t["cells"], t["tables"]).first()
    assert found.is_layout and found.borderless == 1.0 and found.n_rows == 2
    levels = t["blocks"].join(t["styles"], [t["blocks"].doc_id == t["styles"].doc_id, t["blocks"].style == t["styles"].style_id]).select(structure.heading_level(F.col("style"), F.col("name"), F.col("outline_level")).alias("v"))
    assert [r.v for r in levels.collect()] == [1]
    tex = latex.tables(t["cells"]).first().tex
    assert "\\multicolumn{2}{l}{SKILLS} \\\\ \\hline" in tex and "text one &  \\\\ \\hline" in tex


def test_markup(spark):
    text = "# I Intro\nfirst\n\n## A. Part\n\\begin{tabular}{l|c|r}\na & b & c \\\\ \\hline\nx & y & z \\\\\n\\end{tabular}\n\\[ x = 1 \\tag{4} \\]\n$$ y $$\n- one\n2. two\nReferences\n\n[1] a\n[2] b"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    assert rows(markup.markdown_outline(docs).select("level", "title", "content_preview"), "level")[0] == (1, "I Intro", "first \\begin{tabular}{l|c|r}")
    assert rows(markup.tabulars(docs), "line_number") == [("d", 5, 3, 2)]
    assert rows(markup.equations(docs).select("is_numbered", "equation_number", "latex"), "latex") == [(True, 4, "x = 1"), (False, None, "y")]
    p = markup.parameters(docs).first()
    assert (p.heading_pattern, p.total_sections, p.numbered_list_count, p.bullet_list_count, p.reference_count) == ("roman", 2, 1, 1, 2)
    tex = spark.createDataFrame([("d", "\\section{One}\nwords \\textbf{x} here\n\\subsection*{Two}")], "doc_id string, text string")
    assert rows(markup.latex_outline(tex).select("level", "title", "content_preview"), "level") == [(1, "One", "words  here"), (2, "Two", "")]


def test_label_files(spark, tmp_path):
    (tmp_path / "coco.json").write_text('{"images": [{"id": 1, "file_name": "a", "width": 100, "height": 200}, {"id": 2, "file_name": "b", "width": 10, "height": 10}], "annotations": [{"id": 5, "image_id": 1, "category_id": 3, "bbox": [10, 20, 30, 40]}, {"id": 6, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}]}')
    classes = spark.createDataFrame([(3, 0)], "category_id int, class_id int")
    assert rows(labels.read_coco(spark, str(tmp_path / "coco.json"), classes), "file_name") == [("a", 0, 0.25, 0.2, 0.3, 0.2), ("b", None, None, None, None, None)]
    (tmp_path / "x.txt").write_text("0 0.5 0.5 0.1 0.1\n\nshort line\n")
    assert rows(labels.read_yolo(spark, str(tmp_path / "x.txt")), "stem") == [("x", 0, 0.5, 0.5, 0.1, 0.1)]
    (tmp_path / "bank.txt").write_text("tok 0 0 100 100 0 0 0 font title\nbad 0 0 x 1 0 0 0 f title\nfew 1 2\n")
    assert [(r.token, r.x1, r.label) for r in labels.read_docbank(spark, str(tmp_path / "bank.txt")).collect()] == [("tok", 0.1, "title")]
    boxes = spark.createDataFrame([("a", 0, 1, 0.5, 0.5, 0.2, 0.2), ("a", 1, 1, 3.0, 0.5, 0.2, 0.2)], "file_name string, ord int, class_id int, cx double, cy double, w double, h double")
    assert label_sinks.yolo_files(boxes).first().content == "1 0.500000 0.500000 0.200000 0.200000"


def test_latex_and_reports(spark):
    frame = spark.createDataFrame([("d", 0, "x")], "doc_id string, ord int, tex string")
    assert "\\begin{document}\nx\n\\end{document}" in latex.documents(frame, spark.createDataFrame([("d", "p")], "doc_id string, preamble string")).first().tex
    content = F.array(F.struct(F.lit("a_b").alias("text"), F.lit(True).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("underline")))
    assert spark.range(1).select(latex.spans(content)).first()[0] == r"\textbf{a\_b}"
    worst = spark.createDataFrame([(1, "d", "title", 0.25)], "rank long, doc_id string, label string, score double")
    assert reports.offenders_markdown(worst).first()[0].endswith("| 1 | d | title | 0.250 |")


@pytest.mark.parametrize("seconds", [10])
def test_cooldown(spark, seconds):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, i, start + timedelta(seconds=s)) for i, s in enumerate((0, 9, 10, 15, 19, 20, 31))] + [(2, 99, start)], "user_id long, event_id long, ts timestamp")
    assert [r.event_id for r in cooldown.accepted(events, "user_id", "ts", "event_id", seconds).orderBy("event_id").collect()] == [0, 2, 5, 6, 99]


def test_cooldown_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    source = tmp_path / "in"
    spark.createDataFrame([(1, i, start + timedelta(seconds=s)) for i, s in enumerate((0, 9, 10, 15, 20))], "user_id long, event_id long, ts timestamp").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(source)).withWatermark("ts", "1 minute")
    query = cooldown.accepted_stream(stream, "user_id", "ts", "event_id", 10).writeStream.format("memory").queryName("passed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.event_id for r in spark.table("passed").collect()) == [0, 2, 4]


def test_fuzzy_missing_compares_all_pairs(spark):
    """Near matches that differ at the front, in the middle and at the end, against every pair's ratio."""
    rng = random.Random(5)
    words = ["that", "onesen", "erblest", "hein", "inenan", "der", "besch", "thou", "rieraux", "le", "rele", "éon"]
    refs = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 45))) for _ in range(60)] + ["", "x", None]
    gens = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 45))) for _ in range(300)] + ["", None, "x" * 70_000]
    for k, a in enumerate(refs[:50]):
        b = [c for c in a if rng.random() > 0.01 * (k % 20)]
        for _ in range(k % 12):
            b.insert(rng.randint(0, len(b)), rng.choice("abc "))
        gens.append(("7 Word " if k % 3 == 0 else "") + "".join(b).swapcase() if k % 10 == 9 else ("Q" if k % 2 else "12 ") + "".join(b))
    rows = lambda texts: spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, s string")
    near = lambda a: a is not None and any(b is not None and difflib.SequenceMatcher(None, a, b).ratio() > 0.85 for b in gens)
    want = {k for k, a in enumerate(refs) if not near(a)}
    assert 10 < len(want) < 50
    assert {r.k for r in matching.fuzzy_missing(rows(refs), rows(gens), "s").collect()} == want
    assert {r.k for r in matching.fuzzy_missing(rows(refs), rows(gens).limit(0), "s").collect()} == set(range(len(refs)))
    first = spark.createDataFrame([("The passage was copied with one word put in front.",)], "s string")
    later = spark.createDataFrame([("And the passage was copied with one word put in front.",)], "s string")
    assert matching.fuzzy_missing(first, later, "s").count() == 0
