"""Queries without an SQL twin, and operators that no query runs, against plain versions."""

import difflib
import re
import unicodedata
import zipfile
from collections import defaultdict

import pandas as pd
import pytest

from pagewright.functions import text as t
from pagewright.operators import documents, matching, pagination
from pagewright.plans import catalogue
from pagewright.sinks import reports

SF = "/root/testdata/sf0.001"


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def result(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def test_doc_nfkc(spark):
    docs = dict(table("documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    plain = lambda s: " ".join(unicodedata.normalize("NFKC", s).translate({0xAD: None, 0x200B: None, 0xFEFF: None}).split())
    got = {r.doc_id: r.norm for r in result(spark, "doc_nfkc")}
    assert got == {k: plain(s) for k, s in docs.items()}


def test_page_fit(spark):
    got = {r.doc_id: (r.squeeze, r.pages, r.tries) for r in result(spark, "page_fit")}
    for key in table("supplier")["s_suppkey"]:
        target, step, best, tries = key % 4 + 2, 90, None, 0
        for _ in range(8):
            if not 30 <= step <= 110:
                break
            pages = step * (key % 7 + 3) // 100
            tries += 1
            if best is None or abs(pages - target) < abs(best[1] - target):
                best = (step / 100, pages)
            if pages == target:
                break
            step += -8 if pages > target else 2
        assert got[key] == (*best, tries)


def greedy(pairs):
    """(ref, gen): score of the pairs (doc, ref, gen, score) that the fold keeps."""
    out, taken, done = {}, set(), set()
    for doc, ref, gen, score in sorted(pairs, key=lambda p: (p[0], p[1], -p[3], p[2])):
        if (doc, ref) not in done and (doc, gen) not in taken:
            done.add((doc, ref))
            taken.add((doc, gen))
            out[ref, gen] = score
    return out


def test_title_matches(spark):
    pages = table("pages")
    sides = defaultdict(lambda: ([], []))
    for key, html in zip(pages["page_id"], pages["html"], strict=True):
        title = re.search(r"<h1[^>]*>([^<]*)</h1>", html)
        plain = re.sub(r"[^\w\s]", "", re.sub(r"^[\d.]+\s*", "", title[1] if title else "")).lower().strip()
        sides[key // 4][key % 2].append((key, plain))
    pairs = []
    for doc, (ref, gen) in sides.items():
        scored = [(doc, a, b, difflib.SequenceMatcher(None, x, y).ratio()) for a, x in ref for b, y in gen]
        pairs += [p for p in scored if p[3] > 0.3]
    assert {(r.ref_ord, r.gen_ord): r.score for r in result(spark, "title_matches")} == pytest.approx(greedy(pairs), abs=1e-5)


def similarity(a, b):
    x, y = a.lower().strip(" "), b.lower().strip(" ")
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if x in y or y in x:
        return min(len(x), len(y)) / max(len(x), len(y))
    u, v = ({w for w in re.split(r"[ \t\n\x0b\f\r]+", z) if w} for z in (x, y))
    return len(u & v) / len(u | v) if u and v else 0.0


def test_greedy_match(spark):
    texts = dict(table("documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    boxes = {r.vec_id: (r.page, r.x0, r.y0, r.x1, r.y1) for r in catalogue._boxes(spark, SF).collect() if r.vec_id in texts}
    sides = defaultdict(list)
    for key, (page, *box) in boxes.items():
        sides[page // 4].append((key, page, box))
    pairs = []
    for doc, rows in sides.items():
        for a, p, (x0, y0, x1, y1) in rows:
            for b, q, (u0, v0, u1, v1) in rows:
                q, u0 = q + (q % 4 == 3), u0 * 0.98
                if abs(p - q) > 1:
                    continue
                both = max(min(x1, u1) - max(x0, u0), 0) * max(min(y1, v1) - max(y0, v0), 0)
                iou = both / ((x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - both) if both > 0 else 0.0
                text = similarity(texts[a], texts[b])
                score = 0.4 * iou + 0.6 * text - 0.1 * abs(p - q)
                if score > 0.4 and (iou > 0.2 or text > 0.4):
                    pairs.append((doc, a, b, score))
    assert {(r.ref_ord, r.gen_ord): r.score for r in result(spark, "greedy_match")} == pytest.approx(greedy(pairs), abs=1e-5)


def test_greedy_keeps_documents_and_batches_apart(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pairs = [(d, r, x, (r * 7 + x * 5 + (d or 0)) % 11 / 11) for d in (None, 1, 2) for r in range(6) for x in range(5)]
        frame = spark.createDataFrame(pairs, "doc_id long, ref_ord long, gen_ord long, score double")
        got = {(r.doc_id, r.ref_ord, r.gen_ord) for r in matching.greedy(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for d in (None, 1, 2):
        want |= {(d, r, x) for r, x in greedy([(0, r, x, s) for e, r, x, s in pairs if e == d])}
    assert got == want


def test_fuzzy_missing(spark):
    cut = lambda s: [p.strip(" ") for p in (s or "").replace(". ", ".\n").split("\n") if len(p.strip(" ")) > 30]
    gens = sorted({x for s in table("documents")["text"] for x in cut(s)}, key=len)
    bench = [(k, x) for k, s in table("benchmark")[["item_id", "text"]].itertuples(index=False, name=None) for x in cut(s)]
    known, near = set(gens), {}
    for _, x in bench:
        if x in near or x in known:
            continue
        m = difflib.SequenceMatcher(None)
        m.set_seq2(x)
        near[x] = False
        for y in gens:
            if 2 * min(len(x), len(y)) / (len(x) + len(y)) <= 0.85:
                continue
            m.set_seq1(y)
            if m.quick_ratio() > 0.84 and difflib.SequenceMatcher(None, x, y).ratio() > 0.85:
                near[x] = True
                break
    want = sorted((k, x) for k, x in bench if x not in known and not near[x])
    assert sorted((r.item_id, r.sentence) for r in result(spark, "fuzzy_missing")) == want


def test_inherited_follows_chains_of_any_length(spark):
    chain = [("d", f"s{k}", f"s{k - 1}" if k else None, 7.0 if k == 0 else None) for k in range(150)]
    loop = [("d", "x", "y", None), ("d", "y", "z", None), ("d", "z", "x", None), ("e", "s5", "s4", None)]
    got = {(r.doc_id, r.style_id): r.size for r in documents.inherited(spark.createDataFrame(chain + loop, "doc_id string, style_id string, based_on string, size double"), "size").collect()}
    assert all(got["d", f"s{k}"] == 7.0 for k in range(150)) and {got["d", c] for c in "xyz"} == {None} and got["e", "s5"] is None


def test_first_region_with_nulls_and_points(spark):
    """A null in any column of a point, units of any size, repeated points."""
    points = spark.createDataFrame([(1, None, 30.0, 40.0), (1, None, 30.0, 40.0), (1, "n", 500.0, 700.0), (None, "a", 30.0, 40.0)], "page int, note string, x double, y double")
    regions = spark.createDataFrame([(1, 0, "big", 0.0, 0.0, 600.0, 50.0), (1, 1, "other", 0.0, 0.0, 90.0, 90.0)], "page int, ord int, label string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.page or 0, r.label) for r in matching.first_region(points, regions, ["page"]).collect())
    assert got == [(0, "unknown"), (1, "big"), (1, "big"), (1, "unknown")]
    assert matching.first_region(points, regions.limit(0), ["page"]).where("label = 'unknown'").count() == 4


def test_latex_escape_of_control_characters(spark):
    texts = ["\x01", "\x01\x02", "\x01\x03\\", "a\\b{c}", "\\\x01\x02", None]
    got = [r.tex for r in spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "k int, s string").orderBy("k").select(t.latex_escape(catalogue.F.col("s")).alias("tex")).collect()]
    assert got == ["\x01", "\x01\x02", "\x01\x03\\textbackslash{}", "a\\textbackslash{}b\\{c\\}", "\\textbackslash{}\x01\x02", ""]


def test_best_matches_odd_texts(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id string, ord long, text string")
    lines = rows(("a", 0, None), ("a", 1, "  "), ("a", 2, "Two  WORDS"), ("a", 3, "art"), ("b", 0, "none"), ("c", 0, "x y z"))
    targets = rows(("a", 10, "other"), ("a", 11, "two words"), ("a", 12, "two words"), ("a", 13, "party time"), ("a", 14, None), ("c", 5, "x q"), ("c", 6, "z y x w"))
    got = {(r.doc_id, r.ord): (r.best, r.score) for r in pagination.best_matches(lines, targets).collect()}
    assert got == {("a", 0): (None, 0.0), ("a", 1): (None, 0.0), ("a", 2): (11, 1.0), ("a", 3): (13, 0.95), ("b", 0): (None, 0.0), ("c", 0): (6, 0.75)}


def test_zip_directory(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.tex").write_text("a" * 1000)
    (tmp_path / "in" / "sub" / "b.tex").write_text("b")
    reports.zip_directory(str(tmp_path / "in"), str(tmp_path / "out.zip"))
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.namelist() == ["a.tex", "sub/b.tex"] and z.read("sub/b.tex") == b"b" and z.getinfo("a.tex").compress_type == zipfile.ZIP_DEFLATED


def test_rules_apply_in_order_only():
    from pagewright.operators import corrections

    with pytest.raises(ValueError, match="no such rule"):
        corrections.applied(None, {"unheard": None})
