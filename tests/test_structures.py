"""Merged cells, text in boxes, nested blocks, exact splits and running ids, against plain versions."""

import io
import random
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.operators import boxes, grid, nested, ranks
from pagewright.sources import docx

CELL = "t string, row_idx int, cell_idx int, col_span int, v_merge boolean, v_restart boolean, text string"


def plain_rectangles(cells):
    """Cell by cell, row by row; `open_` has the rectangle that may go on at each grid column."""
    out = []
    for name in sorted({c[0] for c in cells}):
        rows = defaultdict(list)
        for c in cells:
            if c[0] == name:
                rows[c[1]].append(c)
        open_, last = {}, None
        for r in sorted(rows):
            now, at = {}, 0
            for _, _, k, span, merge, restart, text in sorted(rows[r], key=lambda c: c[2]):
                span = max(span or 1, 1)
                above = open_.get(at) if last == r - 1 else None
                if merge and not restart and above is not None and above[4] == span:
                    above[5] += 1
                    above[6] = "\n".join(x for x in (above[6], text) if x)
                    if merge:
                        now[at] = above
                else:
                    found = [name, r, at, k, span, 1, text or ""]
                    out.append(found)
                    if merge:
                        now[at] = found
                at += span
            open_, last = now, r
    return sorted(map(tuple, out))


def test_rectangles_of_random_tables(spark):
    r = random.Random(1)
    cells = [(f"t{t}", i, j, r.choice([1, 1, 1, 1, 2, None, 0]), r.random() < 0.8, r.random() < 0.2, r.choice(["x", "", None, "y"])) for t in range(30) for i in range(r.randint(1, 9)) if r.random() < 0.95 for j in range(r.randint(1, 4))]
    found = grid.rectangles(grid.placed(spark.createDataFrame(cells, CELL), ["t"]), ["t"])
    got = sorted((x.t, x.row_idx, x.grid_col, x.cell_idx, x.col_span, x.row_span, x.text) for x in found.collect())
    assert got == plain_rectangles(cells) and max(x[5] for x in got) > 3
    places = grid.occupancy(found, ["t"]).collect()
    assert len(places) == sum(max(c[3] or 1, 1) for c in cells)
    twice = Counter((p.t, p.place_row, p.place_col) for p in places)
    assert {p.t: p.n_twice for p in grid.problems(found, ["t"]).collect()} == {t: sum(n > 1 for (x, _, _), n in twice.items() if x == t) for t in {c[0] for c in cells}}


def test_rectangles_of_nothing(spark):
    none = spark.createDataFrame([], CELL)
    found = grid.rectangles(grid.placed(none, ["t"]), ["t"])
    assert found.count() == 0 and grid.problems(grid.sized(found, F.array(F.lit(1))), ["t"]).count() == 0


def test_alignment(spark):
    names = [None, "top", "center", "bottom", "both", "distributed", "justify", "odd"]
    got = spark.createDataFrame([(n,) for n in names], "v string").select(grid.alignment(F.col("v"))).collect()
    assert [x[0] for x in got] == ["top", "top", "center", "bottom", "center", "center", "center", "top"]


def word_file(path, body):
    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"{head}{body}</w:body></w:document>")
    path.write_bytes(buffer.getvalue())


def test_merged_cells_of_a_word_file(spark, tmp_path):
    p = lambda *texts: "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts)
    cell = lambda text, *props: f"<w:tc><w:tcPr>{''.join(props)}</w:tcPr>{p(*text)}</w:tc>"
    begin, on, wide = '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:gridSpan w:val="2"/>'
    row = lambda *cells, height=None, before=None: "<w:tr><w:trPr>" + (f'<w:trHeight w:val="{height}"/>' if height else "") + (f'<w:gridBefore w:val="{before}"/>' if before else "") + "</w:trPr>" + "".join(cells) + "</w:tr>"
    widths = "".join(f'<w:gridCol w:w="{w}"/>' for w in (1000, 500, 300))
    body = f"""<w:tbl><w:tblPr><w:tblCellMar><w:left w:w="10"/><w:top w:w="7"/></w:tblCellMar></w:tblPr><w:tblGrid>{widths}</w:tblGrid>
      {row(cell(["tall", "second"], begin, '<w:vAlign w:val="both"/>', '<w:tcMar><w:left w:w="99"/><w:right w:w="x"/></w:tcMar>'), cell(["head"], wide), height=240)}
      {row(cell(["more"], on), cell(["b"]), cell(["c"], begin), height=100)}
      {row(cell([""], on), cell(["d"]), cell([""], on))}
      {row(cell(["e"], begin), cell(["f"]), cell(["g"], on))}
      {row(cell(["right"], '<w:gridSpan w:val="odd"/>'), before=2)}
    </w:tbl>"""
    word_file(tmp_path / "a.docx", body)
    word_file(tmp_path / "b.docx", p("no table"))
    found = docx.grids(docx.read(spark, str(tmp_path)))
    got = {x.text: x for x in found["grid_cells"].collect()}
    place = lambda t: (got[t].row_idx, got[t].grid_col, got[t].col_span, got[t].row_span, got[t].width, got[t].height)
    assert set(got) == {"tall\nsecond\nmore", "head", "b", "c\ng", "d", "e", "f", "right"}
    assert place("tall\nsecond\nmore") == (0, 0, 1, 3, 1000.0, 340) and place("head") == (0, 1, 2, 1, 800.0, 240) and place("c\ng") == (1, 2, 1, 3, 300.0, 100)
    assert place("e") == (3, 0, 1, 1, 1000.0, None) and place("right") == (4, 2, 1, 1, 300.0, None)
    assert got["tall\nsecond\nmore"].v_align == "center" and got["tall\nsecond\nmore"].margins == {"left": 99, "top": 7} and got["b"].margins == {"left": 10, "top": 7}
    inside = [(b.row_idx, b.grid_col, b.place) for b in found["grid_blocks"].orderBy("row_idx", "grid_col", "place").collect()]
    assert inside[:3] == [(0, 0, 1), (0, 0, 2), (0, 1, 1)] and len(inside) == 9


def made_boxes(seed, n, pages=3):
    r = random.Random(seed)
    rows = [(r.randrange(pages), k, (x := r.uniform(-50, 600)), (y := r.uniform(0, 800)), x + r.choice([3, 20, 80, 500]) * r.random(), y + r.choice([3, 10, 300]) * r.random()) for k in range(n)]
    return rows + [(0, n, 5.0, 5.0, 5.0, 9.0), (0, n + 1, 9.0, 9.0, 2.0, 2.0), (0, n + 2, None, 1.0, 2.0, 2.0), (1, n + 3, -1e4, -1e4, 1e4, 1e4), (99, n + 4, 0.0, 0.0, 1.0, 1.0)]


@pytest.mark.parametrize("of", ["a", "b", "min"])
def test_overlaps_are_those_of_all_pairs(spark, of):
    schema = "page int, id int, x0 double, y0 double, x1 double, y1 double"
    one, other = made_boxes(1, 150), made_boxes(2, 300)

    def share(a, b):
        wide, high = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        area = lambda x: (x[4] - x[2]) * (x[5] - x[3])
        return max(wide, 0) * max(high, 0) / {"a": area(a), "b": area(b), "min": min(area(a), area(b))}[of]

    whole = lambda rows: [x for x in rows if None not in x and x[4] > x[2] and x[5] > x[3]]
    want = {(a[0], a[1], b[1]): share(a, b) for a in whole(one) for b in whole(other) if a[0] == b[0] and share(a, b) > 0.1}
    for cells in (1, 7, 64):
        got = boxes.overlapping(spark.createDataFrame(one, schema), spark.createDataFrame(other, schema), ["page"], "id", "id", 0.1, of, cells).collect()
        assert len(got) == len(want) > 50 and {(x.page, x.a, x.b): pytest.approx(x.share) for x in got} == want


def test_clipped_text(spark):
    schema = "page int, id int, x0 double, y0 double, x1 double, y1 double, text string"
    regions = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0, None), (0, 2, 5.0, 0.0, 20.0, 10.0, None), (0, 3, 50.0, 50.0, 60.0, 60.0, None), (1, 4, 0.0, 0.0, 10.0, 10.0, None)], schema)
    words = spark.createDataFrame([(0, 10, 6.0, 1.02, 8.0, 2.0, " b "), (0, 11, 1.0, 1.0, 3.0, 2.0, "a"), (0, 12, 1.0, 4.0, 2.0, 5.0, "c"), (0, 13, 9.5, 4.0, 11.0, 5.0, "out"), (0, 14, 51.0, 51.0, 52.0, 52.0, " "), (1, 15, 1.0, 1.0, 2.0, 2.0, None), (0, 16, 1.0, 1.0, 3.0, 2.0, "a2")], schema)
    got = {x.id: (x.text, x.n_words) for x in boxes.clipped_text(regions, words, ["page"], "id", "id").collect()}
    assert got == {1: ("a a2 b\nc", 4), 2: ("b\nout", 2)}
    assert boxes.clipped_text(regions, words.limit(0), ["page"], "id", "id").count() == 0 and boxes.clipped_text(regions.limit(0), words, ["page"], "id", "id").count() == 0


def test_paths_with_circles_orphans_and_depth(spark):
    deep = [("deep", k, k - 1 if k else None) for k in range(300)]
    circles = [("c", 1, 3), ("c", 2, 1), ("c", 3, 2), ("c", 0, 3), ("c", 9, 9), ("c", 8, 9), ("c", 5, 77), ("c", 6, 5)]
    got = {(x.doc_id, x.ord): (x.path, x.depth) for x in nested.paths(spark.createDataFrame(deep + circles, "doc_id string, ord int, parent int")).collect()}
    assert len(got) == 308 and got["deep", 299] == (list(range(300)), 299)
    # 0 hangs on the circle of 1, 2 and 3 and is less than all of it, but not part of it
    assert {o: p for (d, o), (p, _) in got.items() if d == "c"} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 0: [1, 2, 3, 0], 9: [9], 8: [9, 8], 5: [5], 6: [5, 6]}
    assert nested.paths(spark.createDataFrame([], "doc_id string, ord int, parent int")).count() == 0


def test_nested_texts_of_random_trees(spark):
    r = random.Random(7)
    kinds, scopes = ("table", "list", "textbox", "paragraph"), ("body", "header", "footer")
    blocks = [(f"d{d}", k, r.randrange(k) if k and r.random() < 0.85 else None, r.choice(kinds), r.choice(scopes)) for d in range(6) for k in range(40)]
    own = {(d, k): r.choice(["", f"t{k}", f" t{k}\n"]) for d, k, *_ in blocks}
    spans = [(d, k, j, c) for (d, k), t in own.items() for j, c in enumerate(t)] + [("d0", 3, 99, None)]
    walked = nested.paths(spark.createDataFrame(blocks, "doc_id string, ord int, parent int, kind string, scope string"))
    texts = nested.block_texts(walked, spark.createDataFrame(spans, "doc_id string, block int, ord int, text string"))
    inside = defaultdict(list)
    for d, k, up, *_ in blocks:
        inside[d, up].append(k)
    kind = {(d, k): x for d, k, _, x, _ in blocks}

    def said(d, k, table):
        if table and kind[d, k] == "table":
            return "TABLE"
        return " ".join(x for x in (own[d, k].strip(), *(said(d, c, table) for c in inside[d, k])) if x)

    for table in ("TABLE", None):
        got = {(x.doc_id, x.ord): x.text for x in nested.nested_texts(walked, texts, kinds, table=table).collect()}
        assert got == {(d, k): said(d, k, table) for d, k, *_ in blocks}
    lines = {x.doc_id: x.text for x in nested.document_text(walked, texts).collect()}
    assert lines == {d: "\n".join(t for k in inside[d, None] if (t := own[d, k].strip())) for d in {b[0] for b in blocks} if any(own[d, k].strip() for k in inside[d, None])}
    figures = spark.createDataFrame([(d, 100 + k, k, k % 3 > 0) for d, k, *_ in blocks], "doc_id string, ord int, block int, floating boolean")

    def walk(d, scope, up=None, boxed=False):
        for k in inside[d, up]:
            here = boxed or kind[d, k] == "textbox"
            if k % 3 and not here and (scope_of[d, k] == "header") == (scope == "header") and scope_of[d, k] != "footer":
                yield 100 + k
            yield from walk(d, scope, k, here)

    scope_of = {(d, k): s for d, k, _, _, s in blocks}
    got = defaultdict(list)
    for x in nested.floating(walked, figures).orderBy("doc_id", "place").collect():
        got[x.doc_id].append(x.ord)
    assert got == {d: [*walk(d, "body"), *walk(d, "header")] for d in {b[0] for b in blocks}}


@pytest.mark.parametrize(("n", "share"), [(0, 0.1), (1, 0.1), (9, 0.1), (10, 0.1), (1000, 0.1), (999, 0.37), (500, 1.0), (500, 0.0), (30_000, 0.1)])
def test_exact_split(spark, n, share):
    rows = spark.range(n).withColumn("split", F.lit("old"))
    got = ranks.exact_split(rows, "id", share)
    assert Counter(r.split for r in got.collect())["val"] == int(n * share) and got.count() == n and set(got.columns) == {"id", "split"}
    again = ranks.exact_split(rows.repartition(3), "id", share)
    assert got.exceptAll(again).count() == 0


def test_exact_split_of_repeated_rows(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 9 > 0, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("k"), F.lit("same").alias("x"))
    for share in (0.05, 0.5, 0.93):
        got = ranks.exact_split(rows.repartition(7), "k", share, seed=5)
        assert got.where("split = 'val'").count() == int(9000 * share) and got.count() == 9000


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("hot"), F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id")).alias("v"))
    got = ranks.numbered(rows, ["v", "hot"], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 5001))
    assert [(r.v, r.hot) for r in sorted(got, key=lambda r: r.n)] == sorted((r.v, r.hot) for r in got)
    assert ranks.numbered(rows.limit(0), ["v"], "n").count() == 0


def test_coco_tables(spark):
    images = spark.createDataFrame([("b", 0, 200, 100), ("a", 1, 10, 10), ("a", 0, 10, 20)], "doc string, page int, width int, height int")
    labels = spark.createDataFrame([("b", 0, 0, "Table", 0.1, 0.2, 0.3, 0.6), ("a", 0, 1, "odd", 0.0, 0.0, 1.0, 1.0), ("a", 0, 0, "text", 0.5, 0.5, 1.0, 1.0), ("a", 9, 0, "text", 0.0, 0.0, 1.0, 1.0), ("a", 0, 2, None, 0.0, 0.0, 1.0, 1.0)], "doc string, page int, ord int, label string, x0 double, y0 double, x1 double, y1 double")
    shown, marked = ranks.coco_tables(labels, images, {"text": 1, "table": 4})
    assert sorted((r.image_id, r.file_name) for r in shown.collect()) == [(1, "a_p0.jpg"), (2, "a_p1.jpg"), (3, "b_p0.jpg")]
    got = sorted((r.annotation_id, r.image_id, r.category_id, round(r.x, 6), round(r.area, 6), r.yolo) for r in marked.collect())
    assert got == [(1, 1, 1, 5.0, 50.0, "1 0.750000 0.750000 0.500000 0.500000"), (2, 3, 4, 20.0, 1600.0, "4 0.200000 0.400000 0.200000 0.400000")]
