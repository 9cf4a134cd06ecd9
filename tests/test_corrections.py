"""Corrections, rasters and the conversion plan."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import raster
from pagewright.operators import corrections
from pagewright.plans import convert

from test_operators import DOCUMENT, NOTES, NUMBERING, STYLES


def test_blocks_of_diffs(spark):
    diffs = spark.createDataFrame([("d", 0, "missing", "1. Results", None, True, True), ("d", 1, "extra", "", "some words here", False, False), ("d", 2, "missing", "", None, False, False), ("d", 3, "missing", "far away", None, False, False)], "doc_id string, diff_id int, diff_type string, ref_text string, gen_text string, is_heading_like boolean, has_numbering boolean")
    blocks = spark.createDataFrame([("d", "h", 0, "heading", "Results"), ("d", "p", 1, "paragraph", "Some words here"), ("d", "q", 2, "paragraph", "some words here")], "doc_id string, block_id string, ord int, block_type string, text string")
    assert [r.block_id for r in corrections.blocks_of_diffs(diffs, blocks).orderBy("diff_id").collect()] == ["h", "p", None, None]


def test_page_fit(spark):
    targets = spark.createDataFrame([("a", 3), ("b", 3), ("c", 9)], "doc_id string, target int")
    measured = spark.createDataFrame([("a", 90, 5), ("a", 82, 4), ("a", 74, 3), ("b", 90, 4), ("b", 82, 2), ("b", 84, 2), ("b", 86, 2), ("c", 90, 8)], "doc_id string, step int, pages int")
    assert [tuple(r) for r in corrections.fit_pages(targets, measured).orderBy("doc_id").collect()] == [("a", 0.74, 3, 3), ("b", 0.9, 4, 4), ("c", 0.9, 8, 1)]


def test_issues_and_errors(spark):
    runs = spark.createDataFrame([("a", 5000, 0, 30, 4, 4, False, 5, 4), ("b", 10, 0, 30, 4, 4, False, 5, 4), ("c", 5000, 1, 3, 10, 13, True, 3, 4), ("d", None, 0, 0, 0, 0, False, 0, 0)], "doc_id string, gen_size int, exit_code int, gen_blocks int, ref_pages int, gen_pages int, has_empty_pages boolean, report_time int, gen_time int")
    assert [r.issues for r in corrections.run_issues(runs).orderBy("doc_id").collect()] == [[], ["TOO_SMALL"], ["BUILD_FAILED", "FEW_BLOCKS", "PAGE_COUNT", "EMPTY_PAGES", "STALE_REPORT"], ["MISSING"]]
    lines = spark.createDataFrame([("a", 2, "x:Error: late"), ("a", 1, "! first"), ("a", 0, "fine")], "doc_id string, line_no int, line string")
    assert corrections.build_errors(lines).first().first_error == "! first"


def test_regions(spark):
    schema = "doc_id string, label string, confidence double, y0 double, y1 double"
    regions = spark.createDataFrame([("d", "Header", 0.9, 0.1, 0.3), ("d", "header", 0.9, 0.05, 0.25), ("d", "header", 0.5, 0.0, 0.2), ("e", "header", 0.9, 0.0, 0.01)], schema)
    assert [(r.doc_id, r.y0, round(r.y1, 2)) for r in corrections.header_region(regions).collect()] == [("d", 0.05, 0.27)]
    drawings = spark.createDataFrame([("d", 0, 0, 10.0, 10.0, 110.0, 60.0, 600.0, 800.0, "f"), ("d", 0, 1, 0.0, 0.0, 599.0, 799.0, 600.0, 800.0, "f"), ("d", 0, 2, 0.0, 0.0, 40.0, 40.0, 600.0, 800.0, "s")], "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, type string")
    assert [(r.ord, r.confidence) for r in corrections.textbox_regions(drawings).collect()] == [(0, 0.8)]


def test_levels_and_ratios(spark):
    headings = spark.createDataFrame([("d", 0, "1. Intro", 1), ("d", 1, "Other", 1)], "doc_id string, ord int, text string, level int")
    outline = spark.createDataFrame([("d", 0, "Intro", 2), ("d", 1, "1. intro", 3)], "doc_id string, ord int, title string, level int")
    assert [r.level for r in corrections.corrected_levels(headings, outline).orderBy("ord").collect()] == [3, 1]
    metrics = spark.createDataFrame([("d", "ref", 10.0, 0.0), ("d", "gen", 11.0, 3.0)], "doc_id string, side string, font_size double, line_gap double")
    assert tuple(corrections.metric_ratios(metrics).first()) == ("d", pytest.approx(1.1), 1.0)


def test_raster(spark):
    rng = np.random.default_rng(1)
    page = rng.integers(0, 255, (60, 80)).astype(float)
    ref = page[24:40, 32:52]
    assert raster.similarity_of(ref, ref) == (pytest.approx(1.0), "ssim") and raster.similarity_of(ref[:3], ref[:3])[1] == "mad"
    assert raster.best_shift(ref, page, 29, 26, 64)[1:3] == (3, -2)
    frame = spark.createDataFrame([([[0, 255]], [[0, 0]])], "a array<array<int>>, b array<array<int>>")
    assert tuple(frame.select(raster.similarity("a", "b").alias("s")).first().s) == (0.5, "mad")
    assert [r[0] for r in spark.createDataFrame([([255, 254],), ([255, 0],), ([],)], "p array<int>").select(raster.is_blank(F.col("p"))).collect()] == [True, False, True]


def test_conversion(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in (("word/document.xml", DOCUMENT), ("word/styles.xml", STYLES), ("word/numbering.xml", NUMBERING), ("word/footnotes.xml", NOTES)):
            z.writestr(name, content)
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    tex = convert.convert(spark, str(tmp_path)).first().tex
    order = [tex.index(s) for s in ("\\usepackage{tabularx}", "\\begin{document}", "\\section*{Title}", "\\begin{enumerate}\n  \\item \\textbf{item}", "SKILLS", "\\end{document}")]
    assert order == sorted(order)
