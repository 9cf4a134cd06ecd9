"""More queries of the catalogue: layout, Word structure, corrections and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import geometry as g
from pagewright.functions import raster
from pagewright.functions import text as t
from pagewright.operators import calibration, corrections, drift, layout, matching, structure
from pagewright.operators import documents as d
from pagewright.plans.catalogue import BOXES, IOU, LINES, TEX, _boxes, lines
from pagewright.plans.registry import query, table
from pagewright.sinks import latex
from pagewright.sources import labels, markup
from pagewright.streaming import cooldown


# --- runs and windows


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS ord FROM lineitem),
c AS (SELECT *, CASE WHEN l_returnflag = lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY ord) THEN 0 ELSE 1 END AS fresh FROM a),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT l_orderkey AS block_id, l_returnflag AS style, CAST(min(ord) AS INTEGER) AS ord, string_agg(CAST(l_linenumber AS VARCHAR), '' ORDER BY ord) AS text FROM r GROUP BY l_orderkey, run, l_returnflag
""")
def joined_spans(spark, sf_dir):
    """Line items as spans of their order, styled by their flag."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice")
    spans = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("block_id"), F.row_number().over(order).alias("ord"), F.col("l_linenumber").cast("string").alias("text"), F.col("l_returnflag").alias("style"), F.lit(False).alias("is_tab"))
    return d.joined_spans(spans, ["style"]).select("block_id", "style", "ord", "text")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber AS cell_idx, l_linenumber % 3 + 1 AS col_span, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS row_idx FROM lineitem),
o AS (SELECT *, coalesce(sum(col_span) OVER (PARTITION BY l_orderkey, row_idx ORDER BY cell_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT l_orderkey, CAST(row_idx AS INTEGER) AS row_idx, cell_idx, CAST(before AS BIGINT) AS "offset", CAST(max(before + col_span) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n_columns FROM o
""")
def cell_offsets(spark, sf_dir):
    row = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("cell_idx"), (F.col("l_linenumber") % 3 + 1).alias("col_span"), row.alias("row_idx"))
    return d.column_offsets(cells, ["l_orderkey"]).select("l_orderkey", "row_idx", "cell_idx", "offset", "n_columns")


@query("""
WITH c AS (SELECT conv_id, turn, bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS on_ FROM conversations)
SELECT conv_id, turn FROM c WHERE on_
""")
def prefix_strip(spark, sf_dir):
    """Conversations from the first answer on."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role")
    kept = d.without_prefix(turns, F.col("role") != "assistant", F.lit(False))
    return kept.select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 17 AS DOUBLE) AS after, CAST(o_orderkey % 13 AS DOUBLE) AS before, o_orderstatus = 'P' AS void FROM orders)
SELECT o_custkey, o_orderkey, coalesce(greatest(lag(after) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), CASE WHEN lag(after) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NULL THEN NULL ELSE before END), before, 0.0::DOUBLE) AS gap FROM o WHERE NOT void
""")
def collapsed_gaps(spark, sf_dir):
    """Orders as blocks with spacing; pending ones are empty."""
    key = F.col("o_orderkey")
    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.alias("ord"), (key % 17).cast("double").alias("spacing_after"), (key % 13).cast("double").alias("spacing_before"), (F.col("o_orderstatus") == "P").alias("is_empty"))
    return d.collapsed_gaps(blocks).select(F.col("doc_id").alias("o_custkey"), F.col("ord").alias("o_orderkey"), "gap")


@query("""
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row_idx, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS height FROM lineitem),
f AS (SELECT *, coalesce(height, avg(height) OVER (PARTITION BY l_orderkey)) AS h FROM r),
u AS (SELECT *, coalesce(sum(h) OVER (PARTITION BY l_orderkey ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, max(row_idx) OVER (PARTITION BY l_orderkey) AS last FROM f)
SELECT l_orderkey, count(*) FILTER (WHERE upto < 60 AND row_idx < last) AS n_strip FROM u GROUP BY l_orderkey
""")
def header_strip(spark, sf_dir):
    """Orders as grids of which the rows within 60 of the top are stripped."""
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("table_id"), row.alias("row_idx"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("height"))
    found = layout.header_rows(rows, F.lit(60.0))
    return found.groupBy(F.col("table_id").alias("l_orderkey")).agg(F.count_if("strip").alias("n_strip"))


@query(f"""
WITH b AS ({BOXES}), c AS (SELECT vec_id, page, CASE WHEN x0 >= 0.5 THEN 1 ELSE 0 END AS col, round_even(y0, 1) AS y, x0 FROM b)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY page ORDER BY col, y, x0) AS INTEGER) AS place FROM c
""")
def reading_order(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return layout.reading_order(boxes, ["page"], layout.column_index(F.col("x0"), F.array(F.lit(0.5)))).select("vec_id", "place")


@query(f"""
WITH b AS ({BOXES}) SELECT page, count(*) FILTER (WHERE x1 - x0 < 0.6 AND (x0 + x1) / 2 < 0.5) AS n_left, count(*) FILTER (WHERE x1 - x0 < 0.6 AND NOT (x0 + x1) / 2 < 0.5) AS n_right,
  CASE WHEN count(*) FILTER (WHERE x1 - x0 < 0.6 AND (x0 + x1) / 2 < 0.5) >= 3 AND count(*) FILTER (WHERE x1 - x0 < 0.6 AND NOT (x0 + x1) / 2 < 0.5) >= 3 THEN 2 ELSE 1 END AS columns FROM b GROUP BY page
""")
def column_vote(spark, sf_dir):
    return layout.column_vote(_boxes(spark, sf_dir), ["page"])


@query(f"""
WITH b AS ({BOXES}), k AS (SELECT *, label % 2 AS l2 FROM b), c AS (SELECT *, CASE WHEN l2 = lag(l2) OVER (PARTITION BY page ORDER BY ord) THEN 0 ELSE 1 END AS fresh FROM k),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT page, CAST(run AS BIGINT) AS run, CAST(l2 AS INTEGER) AS label, round_even((min(x0) + max(x1)) / 2, 6) AS cx, round_even(max(y1) - min(y0), 6) AS h FROM r GROUP BY page, run, l2 HAVING max(x1) - min(x0) > 0.01 AND max(y1) - min(y0) > 0.005
""")
def token_runs(spark, sf_dir):
    tokens = _boxes(spark, sf_dir).withColumn("doc_id", F.col("page")).withColumn("label", F.col("label") % 2)
    return d.token_runs(tokens).select(F.col("doc_id").alias("page"), "run", "label", F.bround("cx", 6).alias("cx"), F.bround("h", 6).alias("h"))


@query(f"""
WITH b AS ({BOXES}), p AS (SELECT * FROM b WHERE label < 2) SELECT vec_id FROM p UNION ALL SELECT vec_id FROM b WHERE label >= 2 AND page NOT IN (SELECT page FROM p)
""")
def region_cascade(spark, sf_dir):
    """Surer regions, and other ones for pages without these."""
    boxes = _boxes(spark, sf_dir)
    return d.cascade(boxes.where("label < 2"), boxes.where("label >= 2"), "page").select("vec_id")


@query(f"""
WITH b AS (SELECT x.*, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS words FROM ({BOXES}) x JOIN documents d ON d.doc_id = x.vec_id), t AS (SELECT * FROM b WHERE ord < 5), p AS (SELECT * FROM b WHERE ord >= 5),
m AS (SELECT t.vec_id AS ref_ord, p.vec_id AS gen_ord, t.page AS rp, p.page AS gp, {IOU} AS iou, len(list_intersect(t.words, p.words)) AS n, len(t.words) AS a, len(p.words) AS c FROM t JOIN p ON p.page BETWEEN t.page - 2 AND t.page + 2),
j AS (SELECT *, CASE WHEN a = 0 OR c = 0 THEN 0 ELSE n / (a + c - n) END AS text FROM m), k AS (SELECT *, 0.5::DOUBLE * iou + 0.5::DOUBLE * text - CASE WHEN rp <> gp THEN 0.1::DOUBLE ELSE 0 END AS score FROM j)
SELECT ref_ord, gen_ord, round_even(score, 5) AS score FROM k WHERE score > 0 AND (iou >= 0.2 OR text >= 0.3)
""")
def structural_pairs(spark, sf_dir):
    """Structural candidates of boxes with whole texts."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    side = _boxes(spark, sf_dir).join(texts, "vec_id").withColumn("doc_id", F.lit("d")).withColumn("ord_in", F.col("ord")).withColumn("ord", F.col("vec_id"))
    ref, gen = (side.where(half).select("doc_id", "page", "ord", "text", "x0", "y0", "x1", "y1") for half in ("ord_in < 5", "ord_in >= 5"))
    return matching.structural_candidates(ref, gen).select("ref_ord", "gen_ord", F.bround("score", 5).alias("score"))


@query("""
WITH h AS (SELECT event_id, user_id, event_type, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS page, value FROM events WHERE event_id % 2 = 0), g AS (SELECT user_id, event_type, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS page, value FROM events WHERE event_id % 2 = 1),
m AS (SELECT h.event_id, arg_min({'page': g.page, 'y': g.value}, {'far': CASE WHEN g.page <> h.page THEN 1 ELSE 0 END, 'k': CASE WHEN g.page <> h.page THEN CAST(g.page AS DOUBLE) ELSE abs(g.value - h.value) END, 'page': g.page, 'y': g.value}) AS at, any_value(h.page) AS page FROM h JOIN g ON h.user_id = g.user_id AND h.event_type = g.event_type GROUP BY h.event_id)
SELECT h.event_id, m.at.page AS gen_page, CASE WHEN m.at IS NULL THEN 'MISSING' WHEN m.at.page <> m.page THEN 'PAGE_MOVED' ELSE 'FOUND' END AS status FROM h LEFT JOIN m USING (event_id)
""")
def heading_relocation(spark, sf_dir):
    """Even events found again among the odd ones of their user and type: on the same day at the nearest value, else on the
    first other day."""
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("title"), day.alias("page"), F.col("value").alias("y0"))
    found = matching.nearest_heading(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1").withColumnRenamed("title", "text"))
    return found.select(F.col("ord").alias("event_id"), "gen_page", "status")


# --- drift, verdicts, reports


@query(f"""
WITH b AS ({BOXES}), s AS (SELECT a.label, abs(c.y0 - a.y0) * 792 AS shift FROM b a JOIN b c ON a.page = c.page AND a.ord + 5 = c.ord)
SELECT label, count(*) AS n, round_even(sum(shift) / count(*), 4) AS avg_shift FROM s WHERE shift > 20 GROUP BY label
""")
def region_shifts(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    ref = boxes.where("ord < 5").select("page", "ord", "label", (F.col("y0") * 792).alias("ref_y0"))
    gen = boxes.where("ord >= 5").select("page", (F.col("ord") - 5).alias("ord"), (F.col("y0") * 792).alias("gen_y0"))
    return drift.region_shifts(ref.join(gen, ["page", "ord"]), ["label"]).select("label", "n", F.bround("avg_shift", 4).alias("avg_shift"))


@query("""
WITH x AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'missing' WHEN 'view' THEN 'extra' WHEN 'error' THEN 'shifted' ELSE 'other' END AS k FROM events)
SELECT user_id, count(*) FILTER (WHERE k = 'missing') AS missing_count, count(*) FILTER (WHERE k = 'extra') AS extra_count, count(*) FILTER (WHERE k = 'shifted') AS shifted_count, count(*) FILTER (WHERE k = 'changed') AS changed_count FROM x GROUP BY user_id
""")
def diff_counts(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "missing").when(F.col("event_type") == "view", "extra").when(F.col("event_type") == "error", "shifted").otherwise("other")
    return drift.diff_counts(table(spark, sf_dir, "events").select("user_id", kind.alias("diff_type")), ["user_id"])


@query("""
WITH x AS (SELECT s_suppkey, s_nationkey % 4 <> 0 AS same, (s_acctbal + 1000) / 11000 AS sim, CAST(s_suppkey % 20 AS DOUBLE) AS drift FROM supplier)
SELECT s_suppkey, CASE WHEN NOT same THEN 'FAIL_PAGE_COUNT' WHEN sim >= 0.9 AND drift < 10 THEN 'EXCELLENT' WHEN sim >= 0.9 THEN 'GOOD_SSIM_DRIFTED' WHEN sim >= 0.8 THEN 'GOOD' WHEN sim >= 0.7 THEN 'ACCEPTABLE' ELSE 'POOR' END AS verdict,
  CASE WHEN sim < 0.85 OR s_suppkey % 20 > 10 THEN 'CRITICAL' WHEN sim < 0.95 OR s_suppkey % 20 > 0 OR sim < 0.7 THEN 'WARNING' ELSE 'OK' END AS status FROM x
""")
def verdict_ladder(spark, sf_dir):
    sim, off = (F.col("s_acctbal") + 1000) / 11000, F.col("s_suppkey") % 20
    return table(spark, sf_dir, "supplier").select("s_suppkey", drift.page_verdict(F.col("s_nationkey") % 4 != 0, sim, off.cast("double")).alias("verdict"), drift.validation_status(sim, off, sim).alias("status"))


@query("""
WITH g AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(min(event_id) % 3 AS INTEGER) AS ref_pages, CAST(min(event_id) % 2 + 1 AS INTEGER) AS gen_pages FROM events GROUP BY user_id),
l AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS label, CASE WHEN max(value) > 300 THEN 'FAIL' ELSE 'PASS' END AS status FROM events GROUP BY 1, 2), f AS (SELECT doc_id, count(*) FILTER (WHERE status = 'FAIL') AS n FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN abs(gen_pages - ref_pages) >= 1 OR n > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN abs(gen_pages - ref_pages) >= 2 THEN 'WARN_CATASTROPHIC_LAYOUT' WHEN abs(gen_pages - ref_pages) = 1 THEN 'WARN_PAGE_COUNT' WHEN n = 0 THEN NULL ELSE 'WARN_STRUCTURAL_LAYOUT_MISMATCH' END AS warn_class,
  CASE WHEN abs(gen_pages - ref_pages) >= 2 THEN 0 ELSE n END AS n_failed FROM g JOIN f USING (doc_id)
""")
def gate_documents(spark, sf_dir):
    """Users as documents: a type with an event above 300 fails by its drift."""
    events = table(spark, sf_dir, "events").withColumn("doc_id", F.col("user_id").cast("string"))
    pages = events.groupBy("doc_id").agg((F.min("event_id") % 3).cast("int").alias("ref_pages"), (F.min("event_id") % 2 + 1).cast("int").alias("gen_pages"))
    fails = F.max("value") > 300
    found = events.groupBy("doc_id", F.col("event_type").alias("label")).agg(F.when(fails, "FAIL").otherwise("PASS").alias("status"), F.when(fails, F.array(F.lit("median_dy"))).otherwise(F.array().cast("array<string>")).alias("violations"))
    return drift.gate_documents(found, pages)


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_totalprice AS BIGINT) END AS size, o_orderkey % 5 AS code, o_orderkey % 40 AS blocks, o_orderkey % 9 AS rp, o_custkey % 9 AS gp, o_orderkey % 10 = 3 AS void FROM orders)
SELECT o_orderkey, CASE WHEN size IS NULL THEN 'MISSING' WHEN size < 5000 THEN 'TOO_SMALL' ELSE concat_ws(',', CASE WHEN code <> 0 THEN 'BUILD_FAILED' END, CASE WHEN blocks < 20 THEN 'FEW_BLOCKS' END, CASE WHEN rp > 0 AND gp > 0 AND abs(rp - gp) > greatest(1, rp * 0.2) THEN 'PAGE_COUNT' END, CASE WHEN void THEN 'EMPTY_PAGES' END, CASE WHEN rp < gp THEN 'STALE_REPORT' END) END AS issues FROM r
""")
def run_issues(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    runs = table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.when(key % 11 != 0, F.round("o_totalprice").cast("long")).alias("gen_size"), (key % 5).alias("exit_code"), (key % 40).alias("gen_blocks"), (key % 9).alias("ref_pages"), (cust % 9).alias("gen_pages"), (key % 10 == 3).alias("has_empty_pages"), (key % 9).alias("report_time"), (cust % 9).alias("gen_time"))
    return corrections.run_issues(runs, 5000).select(F.col("doc_id").alias("o_orderkey"), F.array_join("issues", ",").alias("issues"))


@query(f"""
WITH l AS ({LINES}), e AS (SELECT doc_id, arg_min(line, ord) AS line FROM l WHERE contains(line, '!!') OR starts_with(line, 'The') GROUP BY doc_id) SELECT doc_id, left(line, 200) AS first_error FROM e
""")
def first_flagged_line(spark, sf_dir):
    """The build-log scan on documents: lines with `!!` or a leading `The` are taken for errors."""
    rows = lines(table(spark, sf_dir, "documents"))
    flagged = rows.where(F.contains("line", F.lit("!!")) | F.startswith("line", F.lit("The"))).select("doc_id", F.col("ord").alias("line_no"), F.concat(F.lit("!"), "line").alias("line"))
    return corrections.build_errors(flagged, 201).select("doc_id", F.expr("substring(first_error, 2)").alias("first_error"))


@query("""
SELECT count(*) AS n, round_even(avg(s), 6) AS mean, count(*) FILTER (WHERE s >= 0.8) AS good, count(*) FILTER (WHERE s >= 0.5 AND s < 0.8) AS fair, count(*) FILTER (WHERE s < 0.5) AS poor FROM (SELECT (c_acctbal + 1000) / 11000 AS s FROM customer)
""")
def corpus_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(((F.col("c_acctbal") + 1000) / 11000).alias("s"))
    return corrections.corpus_summary(rows, "s").select("n", F.bround("mean", 6).alias("mean"), "good", "fair", "poor")


@query("""
WITH a AS (SELECT user_id % 3 AS model, event_type AS kind, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS said, event_id % 4 <> 0 AS valid, event_id % 5 = 0 AS style_ok FROM events)
SELECT model, count(*) AS n, round_even(avg(CAST(valid AS INTEGER)), 3) AS json_valid, round_even(avg(CASE WHEN said = kind THEN 1 ELSE 0 END), 3) AS doc_type, round_even(avg(CAST(style_ok AS INTEGER)), 3) AS layout_style, round_even(avg(CASE WHEN said = kind AND style_ok THEN 1 ELSE 0 END), 3) AS strict FROM a GROUP BY model
""")
def answer_scores(spark, sf_dir):
    key = F.col("event_id")
    said = F.when(key % 4 == 0, F.lit(None)).when(key % 3 == 0, "view").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("model"), F.col("event_type").alias("expected_doc_type"), said.alias("doc_type"), (key % 4 != 0).alias("json_valid"), F.lit("x").alias("expected_layout_style"), F.when(key % 5 == 0, "x").otherwise("y").alias("layout_style"))
    return labels.answer_scores(rows, ["model"])


# --- text, labels, structure


@query(r"""
SELECT page_id, coalesce(nullif(trim(split_part(CASE WHEN page_id % 3 = 0 THEN url || ', proxy' ELSE '' END, ',', 1)), ''), nullif(trim(CASE WHEN page_id % 3 = 1 THEN ' 10.0.0.1 ' ELSE '' END), ''), 'unknown') AS client FROM pages
""")
def client_keys(spark, sf_dir):
    key = F.col("page_id")
    forwarded, real = F.when(key % 3 == 0, F.concat("url", F.lit(", proxy"))).otherwise(""), F.when(key % 3 == 1, " 10.0.0.1 ").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", cooldown.client_key(forwarded, real, F.lit(None).cast("string")).alias("client"))


@query("""
SELECT p_partkey, CASE WHEN trim(n) = '' THEN 'TeX Gyre Heros' WHEN contains(n, 'calibri') THEN 'TeX Gyre Heros' WHEN contains(n, 'courier') OR contains(n, 'mono') THEN 'TeX Gyre Cursor' WHEN contains(n, 'helvetica') OR contains(n, 'arial') OR contains(n, 'sans') THEN 'TeX Gyre Heros' WHEN contains(n, 'times') OR contains(n, 'serif') THEN 'TeX Gyre Termes' WHEN contains(n, 'verdana') THEN 'TeX Gyre Heros' ELSE raw END AS font
FROM (SELECT p_partkey, raw, lower(raw) AS n FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'Courier New' WHEN 2 THEN 'MS Sans Serif' WHEN 3 THEN 'Times' WHEN 4 THEN 'Verdana' ELSE p_name END AS raw FROM part))
""")
def font_names(spark, sf_dir):
    k = F.col("p_size") % 6
    raw = F.when(k == 0, "").when(k == 1, "Courier New").when(k == 2, "MS Sans Serif").when(k == 3, "Times").when(k == 4, "Verdana").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", latex.font(raw).alias("font"))


@query(f"""
WITH l AS ({LINES}), s AS (SELECT doc_id, ord, line, lower(line) AS low, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS words FROM l),
c AS (SELECT *, len(regexp_extract_all(line, '[.!?]')) >= 2 OR length(line) > 120 OR len(regexp_extract_all(line, '[•●○✓*]')) >= 2 AS veto,
  regexp_matches(low, '\\b(19|20)\\d{{2}}\\b') OR regexp_matches(low, '\\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|present|current)\\b') AS dated, regexp_matches(line, ',\\s*[A-Z]{{2}}\\b') AS placed FROM s)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT (veto OR (words > 12 AND NOT dated AND NOT placed)) AND (regexp_matches(low, '{structure.MONTHS}') OR regexp_matches(low, '\\b(19|20)\\d{{2}}\\b') OR regexp_matches(low, '\\b(present|current)\\b') OR regexp_matches(low, '–|—|--') OR placed
  OR (len(regexp_extract_all(line, '[|–—,]')) >= 2 AND length(line) < 80) OR (words <= 8 AND len(regexp_extract_all(line, '\\p{{Nd}}')) >= 4))) AS n_right FROM c GROUP BY doc_id
""")
def right_elements(spark, sf_dir):
    rows = lines(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(structure.is_right_element(F.col("line"))).alias("n_right"))


@query(f"""
WITH l AS (SELECT doc_id, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^#{{1,4}}\\s+.+$')) AS total_sections, count(*) FILTER (WHERE regexp_matches(line, '^\\s*\\d+[.)]\\s')) AS numbered_list_count,
  count(*) FILTER (WHERE NOT regexp_matches(line, '^\\s*\\d+[.)]\\s') AND regexp_matches(line, '^\\s*[*\\-•]\\s')) AS bullet_list_count, 'roman' AS heading_pattern FROM l GROUP BY doc_id
""")
def markup_parameters(spark, sf_dir):
    found = markup.parameters(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "total_sections", "numbered_list_count", "bullet_list_count", "heading_pattern")


@query("""
WITH c AS (SELECT l_orderkey, l_suppkey % 3 AS r, l_linenumber, l_linenumber % 2 + 1 AS span, CASE l_partkey % 4 WHEN 0 THEN 'SKILLS' WHEN 1 THEN '12345' WHEN 2 THEN 'plain words' ELSE '' END AS text FROM lineitem),
r AS (SELECT l_orderkey, r, sum(span) AS cols, count(*) AS n, count(*) FILTER (WHERE span > 1) AS merged, count(*) FILTER (WHERE text IN ('SKILLS', 'plain words')) AS texts, count(*) FILTER (WHERE text = '12345') AS numbers, count(*) FILTER (WHERE text = 'SKILLS') AS titles FROM c GROUP BY 1, 2),
w AS (SELECT l_orderkey, count(*) AS nr, max(cols) AS nc, sum(n) AS cells, sum(merged) AS merged, sum(texts) AS texts, sum(numbers) AS numbers, sum(CASE WHEN r = 0 OR n <= 2 THEN titles ELSE 0 END) AS titles, stddev_pop(cols) AS sd, avg(cols) AS mean FROM r GROUP BY 1),
s AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS bl, least(1.0, merged / cells * 2) AS mr, CASE WHEN nr > 1 THEN least(1.0, sd / greatest(mean, 1.0)) ELSE 0 END AS rv, texts / cells AS th, least(1.0, titles / nr) AS hl, CASE WHEN l_orderkey % 3 = 0 THEN 1.0 WHEN l_orderkey % 3 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS wd FROM w),
p AS (SELECT *, bl * 0.25::DOUBLE + mr * 0.15::DOUBLE + rv * 0.1::DOUBLE + th * 0.15::DOUBLE + hl * 0.2::DOUBLE + wd * 0.15::DOUBLE AS raw FROM s)
SELECT l_orderkey, round_even(score, 5) AS score, score >= 0.45 AS is_layout FROM (SELECT l_orderkey, CASE WHEN ((nr >= 3 AND nc >= 3 AND rv < 0.1 AND hl < 0.1) OR numbers / cells >= 0.4) AND bl + wd < 1.8 THEN least(raw, 0.4) ELSE raw END AS score FROM p)
""")
def layout_table_scores(spark, sf_dir):
    """Orders as tables, their items as cells."""
    kind = F.col("l_partkey") % 4
    cells = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("table_id"), (F.col("l_suppkey") % 3).alias("row_idx"), F.col("l_linenumber").alias("cell_idx"), (F.col("l_linenumber") % 2 + 1).alias("col_span"), F.lit(False).alias("v_merge"), F.when(kind == 0, "SKILLS").when(kind == 1, "12345").when(kind == 2, "plain words").otherwise("").alias("text"), F.lit(False).alias("heading_style"))
    key = F.col("table_id")
    tables = cells.select("doc_id", "table_id").distinct().withColumn("has_borders", key % 2 == 0).withColumn("width", F.when(key % 3 == 0, 9000).when(key % 3 == 1, 6000).otherwise(100))
    return structure.layout_tables(cells, tables).select(F.col("table_id").alias("l_orderkey"), F.bround("score", 5).alias("score"), "is_layout")


@query(f"""
WITH b AS ({BOXES}) SELECT vec_id, CAST(least(greatest(round_even(x0 * 612, 0), 0), 612) AS INTEGER) AS px0, CAST(least(greatest(round_even(y0 * 792, 0), 0), 792) AS INTEGER) AS py0, CAST(least(greatest(round_even(x1 * 612, 0), 0), 612) AS INTEGER) AS px1, CAST(least(greatest(round_even(y1 * 792, 0), 0), 792) AS INTEGER) AS py1 FROM b
""")
def pixel_boxes(spark, sf_dir):
    px = g.to_pixels(g.box(), F.lit(612.0), F.lit(792.0))
    return _boxes(spark, sf_dir).select("vec_id", *[c.alias(f"p{n}") for n, c in zip(("x0", "y0", "x1", "y1"), px, strict=True)])


PIXELS = "list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor(abs(v::DOUBLE) * 1000))) AS INTEGER))"


@query(f"""
WITH p AS (SELECT vec_id, {PIXELS} AS a FROM embeddings), x AS (SELECT p.vec_id, list_sum(list_transform(list_zip(p.a, q.a), lambda z: abs(z[1] - z[2]))) AS s, len(p.a) AS n FROM p JOIN p q ON q.vec_id = p.vec_id + 1)
SELECT vec_id, round_even(greatest(0.0, 1 - CAST(s AS DOUBLE) / n / 255), 6) AS similarity FROM x
""")
def pixel_similarity(spark, sf_dir):
    """Embeddings as rows of grey pixels, each compared to the next."""
    pixels = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.abs(v.cast("double")) * 1000))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pixels.alias("a"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", F.bround(g.mad_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""
WITH p AS (SELECT vec_id, list_transform({PIXELS}, lambda v: 255 - v // 60) AS a FROM embeddings), m AS (SELECT vec_id, CAST(list_sum(a) AS DOUBLE) / len(a) AS mean, CAST(list_sum(list_transform(a, lambda v: v * v)) AS DOUBLE) / len(a) AS sq FROM p)
SELECT vec_id, mean >= 250 AND sq - mean * mean <= 4 AS blank FROM m
""")
def blank_rows(spark, sf_dir):
    pixels = F.transform("embedding", lambda v: (255 - F.floor(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.abs(v.cast("double")) * 1000))) / 60)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", raster.is_blank(pixels).alias("blank"))


@query(r"""
SELECT page_id, '\section*{' || {0} || '}' AS tex FROM (SELECT page_id, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS title FROM pages)
""".replace("{0}", TEX.format("title")))
def heading_tex(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1))
    return table(spark, sf_dir, "pages").select("page_id", latex.heading(F.lit(1), t.latex_escape(title)).alias("tex"))


@query()
def page_fit(spark, sf_dir):
    """Suppliers as documents: the walk from squeeze 0.9 to a target page count."""
    targets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 4 + 2).cast("int").alias("target"))
    steps = targets.select("doc_id", F.explode(F.sequence(F.lit(30), F.lit(110))).alias("step")).withColumn("pages", F.floor(F.col("step") * (F.col("doc_id") % 7 + 3) / 100).cast("int"))
    return corrections.fit_pages(targets, steps)


@query()
def title_matches(spark, sf_dir):
    """Greedy outline matching between neighbouring pages' titles."""
    title = F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)
    rows = table(spark, sf_dir, "pages").select(F.expr("page_id div 4").alias("doc_id"), "page_id", title.alias("title"))
    pairs = matching.outline_pairs(rows.where("page_id % 2 = 0").withColumnRenamed("page_id", "ord"), rows.where("page_id % 2 = 1").withColumnRenamed("page_id", "ord"), 0.3)
    return pairs.select("doc_id", "ref_ord", "gen_ord", F.bround("score", 6).alias("score"))


@query("""
WITH p(profile, fs, ls, sq, ss) AS (VALUES ('academic_twocol', 10.0::DOUBLE, 1.1::DOUBLE, 1.0::DOUBLE, 0.8::DOUBLE), ('academic_singlecol', 11.0, 1.15, 1.0, 1.0), ('resume', 10.5, 1.0, 1.0, 0.7), ('default', 11.0, 1.15, 1.0, 1.0)),
d AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'academic_singlecol' WHEN 1 THEN 'resume' WHEN 2 THEN 'academic_twocol' ELSE 'default' END AS profile, CASE WHEN c_custkey % 3 = 0 THEN 9.0::DOUBLE END AS own FROM customer)
SELECT c_custkey, profile, coalesce(own, fs) AS font_size, ls AS line_spacing, ss AS section_spacing FROM d JOIN p USING (profile)
""")
def calibrated_profiles(spark, sf_dir):
    """Customers as documents of four kinds, one by its other name and one unknown."""
    k = F.col("c_nationkey") % 4
    kind = F.when(k == 0, " Academic").when(k == 1, "resume").when(k == 2, "Academic_TwoCol").otherwise("letter")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), kind.alias("doc_type"), F.when(F.col("c_custkey") % 3 == 0, 9.0).alias("font_size"), F.lit(None).cast("double").alias("section_spacing"))
    found = calibration.calibrated(docs, calibration.profiles(spark))
    return found.select(F.col("doc_id").alias("c_custkey"), "profile", "font_size", "line_spacing", "section_spacing")


@query(f"""
WITH b AS ({BOXES}), y AS (SELECT DISTINCT page, round_even(y0 * 100, 1) AS y FROM b), g AS (SELECT page, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS gap FROM y)
SELECT page, round_even(avg(gap), 6) AS line_spacing FROM g WHERE gap > 8 AND gap < 25 GROUP BY page
""")
def line_spacing(spark, sf_dir):
    spans = _boxes(spark, sf_dir).select("page", (F.col("y0") * 100).alias("y0"))
    return calibration.mean_line_spacing(spans, ["page"]).select("page", F.bround("line_spacing", 6).alias("line_spacing"))


@query(f"""
WITH b AS ({BOXES}) SELECT page, round_even(min(x0) * 600 / 72, 6) AS margin_left, round_even(max(CASE WHEN x1 * 600 > 500 THEN x1 * 600 END), 6) AS right_margin, CASE WHEN avg(CASE WHEN label % 3 = 0 THEN 1 ELSE 0 END) > 0.4 THEN 'serif' ELSE 'sans' END AS family FROM b GROUP BY page
""")
def page_style(spark, sf_dir):
    spans = _boxes(spark, sf_dir).select("page", (F.col("x0") * 600).alias("x0"), (F.col("x1") * 600).alias("x1"), F.when(F.col("label") % 3 == 0, "Times").otherwise("Arial").alias("font"))
    return calibration.page_style(spans, ["page"]).select("page", F.bround("margin_left", 6).alias("margin_left"), F.bround("right_margin", 6).alias("right_margin"), "family")


@query("""
WITH p AS (SELECT user_id, value / 511 AS s, value AS drift, event_id % 3 <> 0 AS r, event_id % 4 <> 0 AS g FROM events)
SELECT user_id, quantile_cont(abs(CASE WHEN r AND g THEN drift END), 0.5) AS median_drift, count(*) FILTER (WHERE r AND g) AS n, round_even(avg(CASE WHEN r AND g THEN s END), 4) AS common, round_even(avg(CASE WHEN r AND g THEN s ELSE 0 END), 4) AS overall FROM p GROUP BY user_id
""")
def page_averages(spark, sf_dir):
    key = F.col("event_id")
    pages = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("value") / 511).alias("similarity"), F.col("value").alias("drift"), (key % 3 != 0).alias("ref_present"), (key % 4 != 0).alias("gen_present"))
    n = pages.groupBy("doc_id").agg(F.count_if(F.col("ref_present") & F.col("gen_present")).alias("n"))
    return calibration.page_averages(pages).join(n, "doc_id").select(F.col("doc_id").alias("user_id"), "median_drift", "n", "common", "overall")
