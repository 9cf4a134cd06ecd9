"""Expressions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import text as t
from pagewright.operators import drift, structure
from pagewright.sources import labels


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (t.containing_similarity, "Intro", "1. Intro", 5 / 8), (t.containing_similarity, "A b", "a B", 1.0), (t.containing_similarity, "", "x", 0.0), (t.containing_similarity, "a b c", "b c d", 0.5),
        (t.block_similarity, "Intro", "1. Intro", 0.5), (t.word_jaccard, "a b", "a b", 1.0), (t.word_jaccard, " ", "a", 0.0), (t.pagination_similarity, "intro", "1. intro", 0.95), (t.match_ratio, "abcd", "bcde", 0.75),
    ],
)
def test_similarities(spark, f, a, b, want):
    assert value(spark, f(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize(
    ("text", "heading", "numbered"),
    [("INTRO", True, False), ("IV. Results", True, True), ("A. Part", True, True), ("3) three", False, True), ("plain text", False, False), ("Our conclusion", True, False), ("A" * 60, False, False)],
)
def test_headings(spark, text, heading, numbered):
    assert value(spark, t.is_heading_like(F.lit(text))) is heading
    assert value(spark, t.has_numbering(F.lit(text))) is numbered


def test_texts(spark):
    assert value(spark, t.normalised(F.lit("ﬁne\u00a0\u00adtext\u200b  x"))) == "fine text x"
    assert value(spark, t.strip_numbering(F.lit("II. Results"))) == "Results"
    assert value(spark, t.strip_numbering(F.lit("3.Results"))) == "Results"
    assert value(spark, t.normalise_title(F.lit("3.1 Über: Alles!"))) == "über alles"
    assert value(spark, t.normalise_label(F.lit(" Section-Header x "))) == "section_header_x"
    assert value(spark, t.normalise_label(F.lit("  "))) is None
    assert value(spark, t.latex_escape(F.lit("a\u00a0b\\c_d {5%} \u2013"))) == r"a~b\textbackslash{}c\_d \{5\%\} --"
    assert value(spark, t.latex_escape(F.lit(None).cast("string"))) == ""
    assert value(spark, t.retry_text(F.lit(89.5))) == "89 seconds"
    assert value(spark, t.retry_text(F.lit(121.0))) == "3 minutes"


def test_boxes(spark):
    a, b = g.Box(*map(F.lit, (0.0, 0.0, 0.5, 0.5))), g.Box(*map(F.lit, (0.25, 0.25, 0.75, 0.75)))
    assert value(spark, g.iou(a, b)) == pytest.approx(0.0625 / 0.4375)
    assert value(spark, g.iou(a, g.Box(*map(F.lit, (0.6, 0.6, 0.7, 0.7))))) == 0
    assert value(spark, g.clamped_iou(a, g.Box(*map(F.lit, (0.4, 0.4, 0.1, 0.1))))) == 0
    assert value(spark, g.yolo_line(F.lit(3), *map(F.lit, (0.5, 0.5, 0.25, 0.0)))) == "3 0.500000 0.500000 0.250000 0.001000"
    assert value(spark, g.yolo_line(F.lit(3), *map(F.lit, (1.5, 0.5, 0.25, 0.1)))) is None
    assert [value(spark, x) for x in g.thousandths(F.array(*map(F.lit, (100.0, 200.0, 300.0, 400.0))))] == [0.2, 0.1, 0.4, 0.3]
    assert [value(spark, x) for x in g.to_pixels(a, F.lit(5.0), F.lit(7.0))] == [0, 0, 2, 4]
    assert value(spark, g.line_spacing_bucket(F.lit(1.3))) == 1.25
    assert value(spark, g.mad_similarity(F.array(F.lit(0), F.lit(255)), F.array(F.lit(0), F.lit(0)))) == 0.5


@pytest.mark.parametrize(
    ("text", "want"),
    [("2019 - 2021", True), ("San Francisco, CA", True), ("Jan 2020 – Present", True), ("", False), ("One. Two. Three", False), ("x" * 130, False), ("just words here", False), ("1234", True), ("* a * b", False)],
)
def test_right_elements(spark, text, want):
    assert value(spark, structure.is_right_element(F.lit(text))) is want


@pytest.mark.parametrize(
    ("style", "name", "outline", "want"),
    [("Heading2", "heading 2", None, 2), ("x", None, 0, 1), ("T", "Title", None, 1), ("h", "Head3", None, 3), ("AbsHead", "AbsHead", None, 1), ("Heading4", None, None, 4), ("Body", "Normal", None, None), (None, "heading 1", None, None), ("H", "Heading", None, 1)],
)
def test_heading_levels(spark, style, name, outline, want):
    text = lambda x: F.lit(x).cast("string")
    assert value(spark, structure.heading_level(text(style), text(name), F.lit(outline).cast("int"))) == want


def test_verdicts(spark):
    lit = F.lit
    assert value(spark, drift.page_verdict(lit(True), lit(0.95), lit(3.0))) == "EXCELLENT"
    assert value(spark, drift.page_verdict(lit(False), lit(0.95), lit(3.0))) == "FAIL_PAGE_COUNT"
    assert value(spark, drift.validation_status(lit(0.96), lit(0), lit(0.8))) == "OK"
    assert value(spark, drift.region_status(lit(True), lit(True), lit(False), lit(True), lit(True))) == "MISSING_PAGE"
    squeeze, line = drift.corrected_spacing(lit(2.0), lit(1.0), lit(1.15))
    assert value(spark, squeeze) == pytest.approx(max(0.6, 2**-0.7)) and value(spark, line) == pytest.approx(max(0.7, 1.15 * 2**-0.7))
    assert value(spark, drift.corrected_block_spacing(lit(12.0), lit(0.01), lit("Text"))) == 8.0


def test_json_answers(spark):
    raw = 'Sure: {not json} {"doc_type": "resume"} and {"x": 1}'
    assert value(spark, labels.first_json(F.lit(raw))) == '{"doc_type": "resume"}'
    assert value(spark, labels.widest_json(F.lit(raw)).isNull())
    assert value(spark, labels.unfenced(F.lit("```json\n{}\n```"))) == "{}"
