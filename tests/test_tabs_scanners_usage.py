"""Tabbed paragraphs, scanners that skip files, and running usage in batch and as a stream, against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.operators import tabs
from pagewright.sources import scanners
from pagewright.streaming import cooldown


def test_two_places_as_c_prints_them(spark):
    r = random.Random(0)
    values = [0.0, 0.125, 0.375, 0.625, 0.875, 0.025, 1.015, 1.005, 2.675, 0.999, 0.995, 15.995, 16.005, 99.995, 1234.565, 1e-9, 0.005] + [k / 1440 for k in range(0, 40_000, 9)] + [r.random() * 10 ** r.randint(0, 4) for _ in range(3000)]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("v", tabs.two_places(F.col("v")).alias("t")).collect()
    assert [(x.v, x.t) for x in got if x.t != f"{x.v:.2f}"] == []


def plain_tabbed(spans, stops, short_only):
    parts, sizes = [""], [0]
    for text, is_tab in spans:
        if is_tab:
            parts.append("")
            sizes.append(0)
        else:
            parts[-1] += text or ""
            sizes[-1] += 1
    if any(a in ("right", "center") for _, a in stops):
        out, at = "\\noindent" + (f"\\makebox[0pt][l]{{{parts[0]}}}" if sizes[0] else ""), 0.0
        for k, text in enumerate(parts[1:]):
            if k < len(stops):
                place = stops[k][0] / 1440
                if place - at > 0:
                    out += f"\\hspace*{{{place - at:.2f}in}}"
                    at = place
                if text:
                    out += f"\\makebox[0pt][{ {'right': 'r', 'center': 'c'}.get(stops[k][1], 'l') }]{{{text}}}"
        return "overlay", out
    out = parts[0]
    for k, text in enumerate(parts[1:]):
        if k < len(stops):
            out += f"\\tabto{{{stops[k][0] / 1440:.2f}in}}{text}"
        else:
            out += ("\\hfill " if not short_only or (k == len(parts) - 2 and len(text) < 30) else "\\quad ") + text
    return "flow", out


@pytest.mark.parametrize("short_only", [True, False])
def test_tabbed_paragraphs(spark, short_only):
    r = random.Random(3)
    spans = {b: [(r.choice(["a", "", None, "some long text " * 3]), r.random() < 0.4) for _ in range(r.randint(1, 9))] for b in range(150)}
    stops = {b: [(r.randint(0, 9000), r.choice(["left", "left", "decimal", None, "right", "center"] if b % 2 else ["left", None])) for _ in range(r.randint(0, 4))] for b in range(150)}
    df = spark.createDataFrame([("d", b, k, t, tab) for b, x in spans.items() for k, (t, tab) in enumerate(x)], "doc_id string, block int, ord int, text string, is_tab boolean")
    st = spark.createDataFrame([("d", b, k, p, a) for b, x in stops.items() for k, (p, a) in enumerate(x, 1)], "doc_id string, block int, k int, position int, alignment string")
    got = {x.block: (x.method, x.tex) for x in tabs.tabbed(df, st, short_only).collect()}
    assert got == {b: plain_tabbed(spans[b], stops[b], short_only) for b in spans}
    assert tabs.tabbed(df.limit(0), st).count() == 0


def files_read(df):
    """How many files the scans of a plan were given, by their metrics."""
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            n.append(metrics.apply("numFiles").value())
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else []
        children = node.children()
        for x in [*inner, *[children.apply(k) for k in range(children.size())]]:
            visit(x)

    visit(plan)
    return sum(n)


def test_filters_skip_files(spark, tmp_path):
    for d in range(4):
        for p in range(5):
            folder = tmp_path / f"set{d % 2}"
            folder.mkdir(exist_ok=True)
            (folder / f"doc{d}_p{p}.txt").write_text(f"1 0.5 0.5 0.2 0.4 0.{d}5\n\nshort 1\n2 0.1 x 0.2 0.2\n0 0.25 0.25 0.5 0.5\n")
    (tmp_path / "plain.name.txt").write_text("7 0.5 0.5 1 1\n")
    found = scanners.scan(spark, "yolo", str(tmp_path), names={0: "table", 1: "text"})
    assert tuple(found.columns) == scanners.REGIONS and found.count() == 41 and files_read(found) == 21
    one = found.where("doc = 'doc2' and page = 3")
    assert files_read(one) == 1
    assert [(r.label, r.confidence, round(r.x0, 6), round(r.y1, 6)) for r in one.orderBy("ord").collect()] == [("text", 0.25, 0.4, 0.7), ("table", None, 0.0, 0.5)]
    assert files_read(found.where("page = 1")) == 4 and files_read(found.where(F.col("doc").isin("doc0", "doc1")).select("label")) == 10
    whole = found.where("doc = 'plain.name'").first()
    assert (whole.page, whole.label, whole.x0, whole.y1) == (0, "7", 0.0, 1.0)
    assert found.where("doc = 'none'").count() == 0


def test_other_scanners(spark, tmp_path):
    (tmp_path / "bank").mkdir()
    (tmp_path / "bank" / "a_p2.txt").write_text("word 100 200 300 400 0 0 0 font paragraph\nshort 1 2\nbad x 200 300 400 0 0 0 font title\n")
    (tmp_path / "said").mkdir()
    (tmp_path / "said" / "b_p0.json").write_text('[{"label": "table", "box": [100, 200, 300, 400], "confidence": 0.5},\n {"box": [1, 2]}, {"box": [0, 0, 1000, 1000]}, {"label": "text", "box": [1, 2, 3, null]}]')
    (tmp_path / "said" / "c.json").write_text("no json")
    (tmp_path / "said" / "d.json").write_text("")
    got = scanners.scan(spark, "docbank", str(tmp_path / "bank")).collect()
    assert [(r.doc, r.page, r.label, r.x0, r.y0, r.x1, r.y1, r.source) for r in got] == [("a", 2, "paragraph", 0.1, 0.2, 0.3, 0.4, "docbank")]
    said = scanners.scan(spark, "answers", str(tmp_path / "said")).orderBy("ord").collect()
    assert [(r.doc, r.ord, r.label, r.confidence, r.x0, r.y0, r.x1, r.y1) for r in said] == [("b", 0, "table", 0.5, 0.2, 0.1, 0.4, 0.3), ("b", 2, "text", None, 0.0, 0.0, 1.0, 1.0)]
    with pytest.raises(ValueError):
        scanners.scan(spark, "unheard", str(tmp_path))
    with pytest.raises(ValueError):
        scanners.scanner("yolo")(lambda spark, path: None)


def test_a_scanner_of_ones_own(spark, tmp_path):
    (tmp_path / "x_p1.txt").write_text("anything")

    @scanners.scanner("whole page")
    def whole_page(spark, path):
        return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.lit(0).alias("ord"), F.lit("page").alias("label"), *[F.lit(float(v)).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 1, 1), strict=True)])

    try:
        assert [(r.doc, r.page, r.x1, r.source) for r in scanners.scan(spark, "whole page", str(tmp_path)).collect()] == [("x", 1, 1.0, "whole page")]
    finally:
        del scanners.SCANNERS["whole page"]


def made_events(spark, n=4000):
    r = random.Random(9)
    rows = [(k, r.choice(["a", "a", "a", "b"]), None if r.random() < 0.02 else int(r.paretovariate(0.5)) % 900, None if r.random() < 0.01 else f"2024-01-0{r.randint(1, 6)} 0{r.randint(0, 9)}:00:00") for k in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, event_type string, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_running_usage(spark):
    rows, df = made_events(spark)
    seen, count, want = defaultdict(set), defaultdict(int), {}
    for k, kind, user, ts in sorted(rows, key=lambda x: (x[3] or "", x[0])):
        seen[kind] |= {user} - {None}
        count[kind] += 1
        want[k] = (kind, len(seen[kind]), count[kind])
    assert {x.event_id: (x.event_type, x.visitors, x.conversions) for x in cooldown.running_usage(df).collect()} == want
    assert cooldown.running_usage(df.limit(0)).count() == 0


def test_stream_of_sketches_agrees_with_batch(spark, tmp_path):
    _, df = made_events(spark)
    df = df.where("ts is not null")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")).withWatermark("ts", "30 days")
    query = cooldown.usage_sketches(stream).writeStream.format("memory").queryName("sketched").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(x.event_type, x.start): (x.visitors, x.conversions) for x in cooldown.running_sketches(spark.table("sketched")).collect()}
    last = {}
    for x in cooldown.running_usage(df).join(df.select("event_id", F.date_trunc("day", "ts").alias("start")), "event_id").collect():
        key = (x.event_type, x.start)
        last[key] = max(last.get(key, (0, 0)), (x.conversions, x.visitors))
    assert set(got) == set(last)
    for key, (conversions, visitors) in last.items():
        assert got[key][1] == conversions and abs(got[key][0] - visitors) <= max(2, 0.05 * visitors)
    parts = cooldown.usage_sketches(df.where("event_id % 2 = 0")).unionByName(cooldown.usage_sketches(df.where("event_id % 2 = 1")))
    assert {(x.event_type, x.start): x.conversions for x in cooldown.running_sketches(parts).collect()} == {k: c for k, (_, c) in got.items()}
