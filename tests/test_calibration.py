"""Profiles, page style and hints."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import calibration as c


def test_profiles(spark):
    docs = spark.createDataFrame([("a", "Academic ", None, None), ("b", "odd", 9.0, 0.5), ("c", "resume", None, None)], "doc_id string, doc_type string, font_size double, section_spacing double")
    measured = spark.createDataFrame([("c", 9.7), ("a", 0.0)], "doc_id string, measured_size double")
    got = c.calibrated(docs, c.profiles(spark), measured)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [("a", "academic_singlecol", 11.0, 1.15, 1.0, 1.0), ("b", "default", 9.0, 1.15, 1.0, 0.5), ("c", "resume", 9.7, 1.0, 1.0, 0.7)]
    own = spark.createDataFrame([("c", "squeeze", 0.8)], "doc_id string, param string, value double")
    assert c.overridden(got, own).where("doc_id = 'c'").first().squeeze == 0.8
    spacing = c.measured_spacing(F.lit(12.0), F.lit(10.0), F.lit(1.0), F.lit(1.5)), c.measured_spacing(F.lit(12.0), F.lit(10.0), F.lit(0.9), F.lit(1.5))
    assert [spark.range(1).select(x).first()[0] for x in spacing] == [1.2, 1.5]


def test_style(spark):
    spans = spark.createDataFrame([("d", 72.0, 520.0, 10.0, "Times"), ("d", 90.0, 400.0, 22.04, "Arial"), ("d", 90.0, 400.0, 100.0, "Arial"), ("e", 90.0, 400.0, 1.0, "Arial")], "doc_id string, x0 double, x1 double, y0 double, font string")
    assert [tuple(r) for r in c.page_style(spans, ["doc_id"]).orderBy("doc_id").collect()] == [("d", 1.0, pytest.approx(1 / 3), 520.0, "sans"), ("e", 1.25, 0.0, None, "sans")]
    assert [(r.doc_id, round(r.line_spacing, 6)) for r in c.mean_line_spacing(spans, ["doc_id"]).collect()] == [("d", 12.0)]


def test_tabs(spark):
    rows = [("d", 0, 0, "a", False), ("d", 0, 1, "\t", True), ("d", 0, 2, "b", False), ("d", 0, 3, "c", False), ("d", 0, 4, "\t", True), ("d", 0, 5, "e", False)]
    spans = spark.createDataFrame(rows, "doc_id string, block int, ord int, text string, is_tab boolean")
    stops = spark.createDataFrame([("d", 0, 1, 700), ("d", 0, 2, 600)], "doc_id string, block int, k int, position int")
    assert [(r.segment, r.text, r.x) for r in c.tab_segments(spans, stops).orderBy("segment").collect()] == [(0, "a", None), (1, "bc", 700), (2, "e", None)]


def test_parts(spark):
    cells = spark.createDataFrame([("d", 0, 0, "side"), ("d", 0, 1, "main"), ("d", 1, 1, "more")], "doc_id string, row_idx int, cell_idx int, text string")
    assert tuple(c.sidebar_split(cells, F.lit(True)).first()) == ("d", "side", "main\nmore")
    pages = spark.createDataFrame([("d", 0.8, 4.0, True, True), ("d", 0.0, 9.0, True, False)], "doc_id string, similarity double, drift double, ref_present boolean, gen_present boolean")
    assert tuple(c.page_averages(pages).first()) == ("d", 0.8, 0.4, 4.0)
    regions = spark.createDataFrame([("d", 0, "Table"), ("d", 1, "odd"), ("d", 2, "text")], "doc_id string, ord int, label string")
    assert c.region_summary(regions, ("table", "text"), 2).first().by_label == {"table": 1, "text": 2}
    images, files = spark.createDataFrame([("x/a.png",), ("x/b.png",)], "path string"), spark.createDataFrame([("y/a.txt",)], "path string")
    assert [r.label_path for r in c.images_with_labels(images, files).orderBy("path").collect()] == ["y/a.txt", None]
    assert spark.range(1).select(c.region_key(F.lit(1), F.lit("t"), F.lit(7))).first()[0] == "p1_t_007"
    sets = {k: spark.createDataFrame([("f", 1)], "file_name string, n int") for k in ("a", "b")}
    assert sorted(r.file_name for r in c.merged_datasets(sets).collect()) == ["a_f", "b_f"]
    figures = spark.createDataFrame([("d", 1, True), ("d", 2, True), ("d", 3, False)], "doc_id string, block long, floating boolean")
    blocks = spark.createDataFrame([("d", 1, "body"), ("d", 2, "footer"), ("d", 3, "body")], "doc_id string, ord long, scope string")
    assert [r.block for r in c.floating_blocks(blocks, figures).collect()] == [1]
    assert spark.range(1).select(c.gate_mode(F.lit(None).cast("string"))).first()[0] == "enforce"
