"""Queries for the operators that the other two modules don't run, over stand-ins made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import geometry as g
from pagewright.functions import text as t
from pagewright.operators import calibration, corrections, drift, header, layout, pagination, scans, structure
from pagewright.operators import documents as d
from pagewright.plans.catalogue import BOXES, TEX, _boxes
from pagewright.plans.registry import query, table
from pagewright.shared import dealt
from pagewright.sinks import latex, reports
from pagewright.sources import labels, markup


def _pick(values, key):
    """The value that a number picks."""
    return F.array(*[F.lit(v) for v in values])[(key % len(values)).cast("int")]


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- Word structure


@query("""
WITH l AS (SELECT n_nationkey AS doc_id, a AS abstract_id, i AS ilvl, (n_nationkey + a + i) % 4 <> 1 AS ordered FROM nation CROSS JOIN (SELECT unnest([0, 1, 2]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS i)),
n AS (SELECT s_nationkey AS doc_id, s_suppkey AS num_id, ilvl, ordered FROM supplier JOIN l ON l.doc_id = s_nationkey AND l.abstract_id = s_suppkey % 3)
SELECT p_partkey AS ord, ordered FROM part LEFT JOIN n ON n.doc_id = p_partkey % 25 AND n.num_id = p_partkey % 40 AND n.ilvl = p_size % 3
""")
def numbering_levels(spark, sf_dir):
    """Parts as paragraphs of nations' documents, numbered by suppliers; some have no such number or level."""
    levels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("abstract_id"))
    levels = levels.select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("ilvl"))
    levels = levels.withColumn("num_fmt", _pick(("decimal", "bullet", "lowerRoman", "upperLetter"), F.col("doc_id") + F.col("abstract_id") + F.col("ilvl")))
    instances = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), (F.col("s_suppkey") % 3).cast("int").alias("abstract_id"), F.col("s_suppkey").alias("num_id"))
    paragraphs = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).cast("int").alias("doc_id"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 40).alias("num_id"), (F.col("p_size") % 3).alias("ilvl"))
    return structure.level_of(paragraphs, structure.numbering(instances, levels)).select("ord", "ordered")


STYLES = [("Heading1", "heading 1", None), ("H2", "heading 2", None), ("Title", "Title", None), ("X", "Normal", 2), ("AbsHead", "AbsHead", None), ("Head3", "Head3", None), ("heading4", "Other", None), ("", "heading 1", None), ("Body", "Body Text", None), ("CCSHead", "ccshead", None), ("Heading", "heading", None)]


@query("""
WITH s(k, id, name, o) AS (VALUES {0}), p AS (SELECT p_partkey, id, lower(name) AS n, lower(id) AS i, o FROM part JOIN s ON k = p_partkey % 11)
SELECT p_partkey, CAST(CASE WHEN id = '' THEN 0 WHEN o IS NOT NULL THEN o + 1 WHEN starts_with(n, 'heading') THEN coalesce(try_cast(nullif(regexp_extract(n, '(\\d+)\\s*$', 1), '') AS INTEGER), 1)
  WHEN n IN ('title', 'titledocument') THEN 1 WHEN regexp_matches(n, '^head.*\\d$') THEN CAST(regexp_extract(n, '(\\d+)$', 1) AS INTEGER) WHEN regexp_matches(n, '(head|header)$') AND regexp_matches(n, 'abs|ack|ccs|keyword|ref|meta') THEN 1
  WHEN starts_with(i, 'heading') THEN coalesce(try_cast(nullif(regexp_extract(i, '(\\d+)$', 1), '') AS INTEGER), 1) ELSE 0 END AS INTEGER) AS level FROM p
""".replace("{0}", ", ".join(f"({k}, '{a}', '{b}', {'NULL' if o is None else o})" for k, (a, b, o) in enumerate(STYLES))))
def style_headings(spark, sf_dir):
    """Parts as paragraphs of eleven styles."""
    styles = spark.createDataFrame([(k, *s) for k, s in enumerate(STYLES)], "k long, style_id string, name string, outline_level int")
    met = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 11).alias("k")).join(styles, "k")
    return met.select("p_partkey", F.coalesce(structure.heading_level(F.col("style_id"), F.col("name"), F.col("outline_level")), F.lit(0)).alias("level"))


@query(f"""
WITH p AS (SELECT p_partkey, {_sql_list(structure.CONTENT_HEADINGS)} AS h, {_sql_list(structure.CONTENT_HEADINGS)}[p_partkey % 15 + 1] AS title, p_size % 5 AS v, p_name, p_partkey % 3 = 0 AS bold FROM part),
x AS (SELECT *, CASE v WHEN 0 THEN title WHEN 1 THEN upper(title) || ' ' WHEN 2 THEN title || ' ' || p_name WHEN 3 THEN title || ' ' || repeat(p_name, 9) ELSE p_name || ' ' || title END AS text FROM p)
SELECT p_partkey, len(list_filter(h, lambda t: trim(lower(text)) = t OR starts_with(trim(lower(text)), t || ' '))) > 0 AND (bold OR length(trim(text)) < 50) AS heading FROM x
""")
def content_headings(spark, sf_dir):
    title, v = _pick(structure.CONTENT_HEADINGS, F.col("p_partkey")), F.col("p_size") % 5
    text = F.when(v == 0, title).when(v == 1, F.concat(F.upper(title), F.lit(" "))).when(v == 2, F.concat_ws(" ", title, "p_name")).when(v == 3, F.concat(title, F.lit(" "), F.repeat("p_name", F.lit(9)))).otherwise(F.concat_ws(" ", "p_name", title))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), (F.col("p_partkey") % 3 == 0).alias("bold"))
    return rows.select("p_partkey", structure.is_content_heading(F.col("text"), F.col("bold")).alias("heading"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS content, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE -1 END AS "right",
  CASE WHEN length(p_name) < 15 THEN 0.22 WHEN length(p_name) < 35 THEN 0.28 ELSE 0.34 END::DOUBLE AS fraction FROM part
""")
def row_patterns(spark, sf_dir):
    """Rows of two cells, of three with a tiny one, and of three wide ones."""
    k, wide = F.col("p_partkey") % 4, F.lit("a cell with text")
    texts = F.when(k == 0, F.array("p_name", "p_brand")).when(k == 1, F.array(F.lit(" a "), F.col("p_name"), wide)).when(k == 2, F.array(wide, F.lit(""), F.col("p_brand"))).otherwise(F.array(wide, wide, wide))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", structure.two_column_cells(texts).alias("cells"))
    return rows.select("p_partkey", F.coalesce(F.col("cells")[0], F.lit(-1)).alias("content"), F.coalesce(F.col("cells")[1], F.lit(-1)).alias("right"), structure.right_fraction(F.col("p_name")).alias("fraction"))


@query("""
WITH s AS (SELECT p_type AS doc_id, max(CASE WHEN p_partkey % 50 = 1 THEN p_brand END) AS a, max(CASE WHEN p_partkey % 50 = 2 THEN p_brand END) AS b FROM part GROUP BY 1),
f AS (SELECT DISTINCT p_type AS doc_id, 'Font of ' || p_type AS font FROM part UNION ALL SELECT 'none', '')
SELECT f.doc_id, coalesce(CASE WHEN f.doc_id < 'L' THEN a END, CASE WHEN f.doc_id < 'P' THEN b END, nullif(f.font, '')) AS font FROM f LEFT JOIN s USING (doc_id)
""")
def body_fonts(spark, sf_dir):
    """Types of parts as documents: some have the style Normal, some the default paragraph font, some neither."""
    k, doc = F.col("p_partkey") % 50, F.col("p_type")
    rows = table(spark, sf_dir, "part")
    name = F.when((k == 1) & (doc < "L"), "Normal").when((k == 2) & (doc < "P"), "Default Paragraph Font").otherwise("Other")
    styles = rows.select(doc.alias("doc_id"), name.alias("name"), F.col("p_brand").alias("font"))
    defaults = rows.select(doc.alias("doc_id"), F.concat(F.lit("Font of "), doc).alias("font")).distinct().unionAll(spark.createDataFrame([("none", "")], "doc_id string, font string"))
    return structure.body_font(styles, defaults)


@query("""
WITH s(ord, text, level) AS (VALUES (0, 'ring', 1), (1, 'A SMALL widget and more', 2), (2, 'widget', 1)), m AS (SELECT p_partkey, s.ord, s.level FROM part JOIN s ON contains(lower(p_name), lower(s.text)) OR contains(lower(s.text), lower(p_name)))
SELECT p_partkey, coalesce(arg_min(m.level, m.ord), 3) AS level FROM part LEFT JOIN m USING (p_partkey) GROUP BY p_partkey
""")
def upgraded_headings(spark, sf_dir):
    """Parts as headings of level 3; three suggestions for each type of part."""
    blocks = table(spark, sf_dir, "part").select(F.col("p_type").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"), F.lit(3).alias("level"))
    some = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(s).alias("text"), F.lit(n).alias("level")) for k, (s, n) in enumerate((("ring", 1), ("A SMALL widget and more", 2), ("widget", 1)))])).alias("s")
    suggestions = blocks.select("doc_id").distinct().select("doc_id", some).select("doc_id", "s.*")
    return structure.upgraded_headings(blocks, suggestions).select(F.col("ord").alias("p_partkey"), "level")


@query("""
SELECT o_custkey, bool_or(o_orderkey % 5 = 0) AS has_tables, bool_or(o_orderkey % 5 = 1) AS has_lists, bool_or(o_orderkey % 5 = 2) AS has_figures, bool_or(o_orderkey % 11 = 0) AS has_floats, max(o_orderkey % 12) > 8 AS needs_ltablex,
  bool_or(o_orderkey % 7 = 0) AS has_urls, bool_or(o_orderkey % 13 = 0) AS has_footnotes FROM orders GROUP BY o_custkey
""")
def feature_flags(spark, sf_dir):
    key = F.col("o_orderkey")
    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), _pick(("table", "list", "figure", "heading", "paragraph"), key).alias("block_type"), (key % 11 == 0).alias("floating"), (key % 12).alias("n_rows"), (key % 7 == 0).alias("has_url"), (key % 13 == 0).alias("has_footnote"))
    return d.feature_flags(blocks).withColumnRenamed("doc_id", "o_custkey")


@query("""
WITH c AS (SELECT l_orderkey, l_suppkey % 5 AS r, l_linenumber % 2 + 1 AS cs, l_partkey % 2 + 1 AS rs FROM lineitem), r AS (SELECT l_orderkey, r, sum(CASE WHEN cs > 1 THEN 1 ELSE 0 END + CASE WHEN rs > 1 THEN 1 ELSE 0 END) AS axes, count(*) AS n FROM c GROUP BY 1, 2)
SELECT l_orderkey, CAST(2 * sum(axes) + CASE WHEN max(n) > 2 THEN 3 ELSE 0 END + CASE WHEN count(*) > 3 THEN 3 ELSE 0 END AS BIGINT) AS complexity FROM r GROUP BY l_orderkey
""")
def parser_complexity(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("row_idx"), (F.col("l_linenumber") % 2 + 1).alias("col_span"), (F.col("l_partkey") % 2 + 1).alias("row_span"))
    return d.parser_complexity(cells, ["l_orderkey"], wide=2, long=3).select("l_orderkey", F.col("complexity").cast("long").alias("complexity"))


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE turn // 3 END AS num, text AS content FROM conversations WHERE turn % 5 <> 3),
f AS (SELECT *, CASE WHEN num IS NOT DISTINCT FROM lag(num) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT conv_id, num, min(turn) AS turn, string_agg(content, '|' ORDER BY turn) AS items FROM r WHERE num IS NOT NULL GROUP BY conv_id, num, run
""")
def list_runs(spark, sf_dir):
    """Turns as list paragraphs, three to a numbering; every fifth has none, and the one before it has no content."""
    turn = F.col("turn")
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("ord"), F.when(turn % 5 == 3, F.lit(-1)).when(turn % 5 != 4, F.expr("turn div 3")).alias("num_id"), F.when(turn % 5 == 3, "").otherwise(F.col("text")).alias("content"), F.lit(True).alias("ordered"))
    found = d.list_runs(blocks)
    return found.select(F.col("doc_id").alias("conv_id"), F.col("num_id").alias("num"), F.col("ord").alias("turn"), F.array_join(F.transform("items", lambda i: i["content"]), "|").alias("items"))


@query(f"""
WITH b AS ({BOXES}), r AS (SELECT page, ord, CASE WHEN label = 0 AND ord % 2 = 0 AND 0.8::DOUBLE + ord / 40 > 0.85 THEN 'ML_TABLE_HIGH_CONF_NO_OOXML' WHEN label = 1 THEN 'ORACLE_TEXTBOX_FLOATING' END AS reason FROM b WHERE ord < 6),
f AS (SELECT page, arg_min(reason, ord) AS reason FROM r WHERE reason IS NOT NULL GROUP BY page)
SELECT vec_id, coalesce(reason, 'DEFAULT_SEMANTIC') AS reason, CASE WHEN reason LIKE 'ML%' THEN 'fallback' ELSE 'semantic' END AS decision FROM b LEFT JOIN f USING (page) WHERE ord >= 6
""")
def region_policy(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).withColumn("doc_id", F.lit("d"))
    kind = F.when(F.col("label") == 0, "Table").when(F.col("label") == 1, "textbox").otherwise("text")
    regions = boxes.where("ord < 6").select("doc_id", "page", "ord", kind.alias("label"), F.when(F.col("ord") % 2 == 0, "ml").otherwise("heuristic").alias("source"), (0.8 + F.col("ord") / 40).alias("confidence"))
    return d.region_policy(boxes.where("ord >= 6").select("doc_id", "page", "vec_id"), regions).select("vec_id", "reason", "decision")


@query("SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'OOXML' WHEN o_orderkey % 7 = 1 THEN 'ML' ELSE 'DEFAULT' END AS reason, count(*) AS n FROM orders GROUP BY 1, 2")
def policy_stats(spark, sf_dir):
    key = F.col("o_orderkey")
    trace = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(key % 3 == 0, "OOXML").when(key % 7 == 1, "ML").otherwise("DEFAULT").alias("reason"))
    return scans.policy_stats(trace).select(F.col("doc_id").alias("o_custkey"), "reason", "n")


# --- text and markup


@query(r"""
WITH p AS (SELECT page_id, (['IV. ', '12. ', 'B. ', '3.1 ', ''])[page_id % 5 + 1] || trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS title FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(title, '^[IVXivx]+\.\s*', ''), '^\d+\.?\s*', ''), '^[A-Z]\.\s*', '')) AS bare, trim(lower(regexp_replace(regexp_replace(title, '^[\d.]+\s*', ''), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', '', 'g'))) AS key FROM p
""")
def stripped_titles(spark, sf_dir):
    """Page titles with numbers of five kinds put in front."""
    title = F.concat(_pick(("IV. ", "12. ", "B. ", "3.1 ", ""), F.col("page_id")), F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)))
    rows = table(spark, sf_dir, "pages").select("page_id", title.alias("title"))
    return rows.select("page_id", t.strip_numbering(F.col("title")).alias("bare"), t.normalise_title(F.col("title")).alias("key"))


@query(r"""
SELECT doc_id, CAST(length(regexp_replace(text, '[\t\n\x0B\f\r\x{85}\p{Z}]', '', 'g')) AS INTEGER) AS dense, CAST(len(regexp_extract_all(text, '\p{L}')) AS INTEGER) AS letters, CAST(len(regexp_extract_all(text, '\p{Nd}')) AS INTEGER) AS digits,
  regexp_matches(text, '[%$€£+=<>]') AS math, CAST(len(regexp_extract_all(text, '[.!?]')) AS INTEGER) AS ends, CAST(len(regexp_extract_all(text, '[•●○✓*]')) AS INTEGER) AS bullets FROM documents
""")
def character_counts(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.dense_length(text).alias("dense"), t.letters(text).alias("letters"), t.digits(text).alias("digits"), t.has_math(text).alias("math"), t.sentence_ends(text).alias("ends"), t.bullets(text).alias("bullets"))


@query(f"SELECT page_id, '\\caption{{' || {TEX.format('title')} || '}}' AS tex FROM (SELECT page_id, trim(regexp_replace(title, '[\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS title FROM (SELECT page_id, replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), ' ', '  ' || chr(10)) || ' 100 % & {{more}}_' AS title FROM pages))")
def captions(spark, sf_dir):
    title = F.concat(F.replace(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1), F.lit(" "), F.lit("  \n")), F.lit(" 100 % & {more}_"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("\\caption{"), t.caption_escape(title), F.lit("}")).alias("tex"))


MARKDOWN = "string_agg(repeat('#', CAST(turn % 5 AS INTEGER)) || ' ' || role || ' ' || CAST(turn AS VARCHAR) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)"


def _markdown(spark, sf_dir):
    """Conversations as Markdown: each turn is a heading, or a line where it has no mark, and its text."""
    part = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 5).cast("int")), F.lit(" "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda s: s["part"]), "\n\n")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(joined.alias("text"))


@query(f"""
WITH m AS (SELECT conv_id, {MARKDOWN} AS text FROM conversations GROUP BY conv_id), l AS (SELECT conv_id, i AS line_number, parts[i] AS line FROM (SELECT conv_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT conv_id, string_split(text, chr(10)) AS parts FROM m))),
b AS (SELECT *, CASE WHEN NOT starts_with(line, '#') THEN trim(line) END AS body FROM l), n AS (SELECT *, lead(body, 1) OVER w AS b1, lead(body, 2) OVER w AS b2, lead(body, 3) OVER w AS b3, lead(body, 4) OVER w AS b4 FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY line_number)),
h AS (SELECT conv_id, line_number, length(regexp_extract(line, '^(#{{1,4}})\\s+.+$', 1)) AS level, trim(regexp_extract(line, '^#{{1,4}}\\s+(.+)$', 1)) AS title, coalesce(b1, '') AS p1, b2, b3, b4 FROM n WHERE regexp_matches(line, '^#{{1,4}}\\s+.+$')),
x2 AS (SELECT *, CASE WHEN length(p1) > 100 OR coalesce(b2, '') = '' THEN p1 WHEN p1 = '' THEN b2 ELSE p1 || ' ' || b2 END AS p2 FROM h), x3 AS (SELECT *, CASE WHEN length(p2) > 100 OR coalesce(b3, '') = '' THEN p2 WHEN p2 = '' THEN b3 ELSE p2 || ' ' || b3 END AS p3 FROM x2)
SELECT conv_id, CAST(line_number AS INTEGER) AS line_number, CAST(level AS INTEGER) AS level, title, CASE WHEN length(p3) > 100 OR coalesce(b4, '') = '' THEN p3 WHEN p3 = '' THEN b4 ELSE p3 || ' ' || b4 END AS content_preview FROM x3
""")
def markdown_outline(spark, sf_dir):
    found = markup.markdown_outline(_markdown(spark, sf_dir))
    return found.select(F.col("doc_id").alias("conv_id"), "line_number", "level", "title", "content_preview")


@query("SELECT c_custkey, CAST(v + 1 AS INTEGER) AS line_number, CAST(c_nationkey % 5 + 1 AS INTEGER) AS column_count, CAST(c_custkey % 120 + 1 - CASE WHEN c_custkey % 120 > 98 THEN c_custkey % 120 - 98 ELSE 0 END AS INTEGER) AS row_count FROM customer, (SELECT unnest([0, 200]) AS v)")
def tabular_counts(spark, sf_dir):
    """Customers as LaTeX texts of two tables each, some with more rows than are looked at."""
    key, rows = F.col("c_custkey"), lambda n: F.repeat(F.lit("a & b \\\\ \n"), n.cast("int"))
    one = F.concat(F.lit("\\begin{tabular}{|"), F.repeat(F.lit("c|"), F.col("c_nationkey") % 5 + 1), F.lit("}\n\\hline\n"), rows(key % 120), F.lit("\\end{tabular}\n"))
    gap = F.repeat(F.lit("text\n"), (197 - key % 120).cast("int"))
    found = markup.tabulars(table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.concat(one, gap, one).alias("text")))
    return found.select(F.col("doc_id").alias("c_custkey"), "line_number", "column_count", "row_count")


@query("SELECT event_id, props AS json, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fenced_answers(spark, sf_dir):
    """Answers inside a code fence."""
    text = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```\n"))
    rows = table(spark, sf_dir, "events").select("event_id", labels.unfenced(text).alias("json"))
    return rows.select("event_id", "json", F.from_json(labels.first_json(F.col("json")), "k long")["k"].alias("k"))


@query("""
SELECT p_partkey, CASE WHEN f = '' THEN 'TeX Gyre Heros' WHEN f = 'Courier New' THEN 'TeX Gyre Cursor' WHEN f = 'Times' THEN 'TeX Gyre Termes' WHEN f = 'Garamond' THEN 'Garamond' ELSE 'TeX Gyre Heros' END AS font,
  CASE WHEN own = '' THEN '' ELSE '{' || own || ' ' END AS "open", CASE WHEN own = '' THEN '' ELSE '}' END AS "close" FROM (SELECT *, concat_ws(' ', CASE WHEN f IN ('Courier New', 'Times', 'Garamond') THEN '\\fontspec{' || CASE f WHEN 'Times' THEN 'TeX Gyre Termes' WHEN 'Garamond' THEN 'Garamond' ELSE 'TeX Gyre Cursor' END || '}' END,
  CASE WHEN p_size % 3 > 0 THEN '\\fontsize{' || CAST(p_size AS VARCHAR) || '.0}{' || CASE p_size % 3 WHEN 1 THEN '14.0' ELSE CAST(p_size * 2 AS VARCHAR) || '.0' END || '}\\selectfont' END) AS own
  FROM (SELECT p_partkey, p_size, (['Calibri', 'Courier New', 'Times', 'Garamond', ''])[p_partkey % 5 + 1] AS f FROM part))
""")
def font_wrappers(spark, sf_dir):
    """Parts as blocks: five fonts in a document of Arial, sizes with exact and multiple spacing."""
    k, size = F.col("p_size") % 3, F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(("Calibri", "Courier New", "Times", "Garamond", ""), F.col("p_partkey")).alias("f"), F.when(k > 0, size).alias("size"), F.when(k == 1, 14.0).when(k == 2, 2.0).alias("spacing"), F.when(k == 1, "exact").otherwise("multiplier").alias("kind"))
    before, after = latex.font_wrapper(F.col("f"), F.col("size"), F.col("spacing"), F.col("kind"), F.lit("Arial"))
    return rows.select("p_partkey", latex.font(F.col("f")).alias("font"), before.alias("open"), after.alias("close"))


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'header' ELSE 'footer' END AS scope, CASE WHEN turn % 4 = 0 THEN 'center' WHEN turn % 4 = 1 THEN 'both' END AS j, CASE WHEN turn % 7 = 2 THEN '' ELSE role || CAST(turn AS VARCHAR) END AS tex FROM conversations)
SELECT conv_id, scope, string_agg(CASE WHEN j = 'center' THEN '\\begin{center}' || chr(10) || tex || chr(10) || '\\end{center}' ELSE tex END, chr(10) || chr(10) ORDER BY turn) AS tex FROM c WHERE tex <> '' GROUP BY 1, 2
""")
def running_blocks(spark, sf_dir):
    """Turns as blocks of headers and footers."""
    turn = F.col("turn")
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("ord"), F.when(turn % 2 == 0, "header").otherwise("footer").alias("scope"), F.when(turn % 4 == 0, "center").when(turn % 4 == 1, "both").alias("justification"), F.when(turn % 7 == 2, "").otherwise(F.concat("role", turn.cast("string"))).alias("tex"))
    return latex.running_blocks(blocks).withColumnRenamed("doc_id", "conv_id")


@query("""
WITH c AS (SELECT l_orderkey, CAST(l_suppkey % 3 AS INTEGER) AS r, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber, l_partkey) AS i, l_linenumber % 2 + 1 AS span, 'x_' || CAST(l_linenumber AS VARCHAR) AS text FROM lineitem),
r AS (SELECT l_orderkey, r, string_agg(CASE WHEN span > 1 THEN '\\multicolumn{2}{l}{' || replace(text, '_', '\\_') || '}' ELSE replace(text, '_', '\\_') END, ' & ' ORDER BY i) AS cells, sum(span) AS w FROM c GROUP BY 1, 2),
m AS (SELECT *, max(w) OVER (PARTITION BY l_orderkey) AS n FROM r)
SELECT l_orderkey, '\\begin{tabularx}{\\linewidth}{|' || repeat('X|', CAST(max(n) AS INTEGER)) || '}' || chr(10) || '\\hline' || chr(10) || string_agg(cells || repeat(' & ', CAST(n - w AS INTEGER)) || ' \\\\ \\hline', chr(10) ORDER BY r) || chr(10) || '\\end{tabularx}' AS tex FROM m GROUP BY l_orderkey
""")
def table_tex(spark, sf_dir):
    """Orders as tables: rows are padded to the widest, wide cells span two columns."""
    place = F.row_number().over(Window.partitionBy("l_orderkey", F.col("l_suppkey") % 3).orderBy("l_linenumber", "l_partkey"))
    cells = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("table_id"), (F.col("l_suppkey") % 3).cast("int").alias("row_idx"), place.alias("cell_idx"), (F.col("l_linenumber") % 2 + 1).alias("col_span"), F.concat(F.lit("x_"), F.col("l_linenumber").cast("string")).alias("text"))
    return latex.tables(cells).select(F.col("table_id").alias("l_orderkey"), "tex")


@query("SELECT s_suppkey, replace(replace(replace(replace(s_name, '#', chr(8211)), chr(8211), '--'), '0', chr(8226)), chr(8226), '\\textbullet{}') AS tex FROM supplier")
def readable_tex(spark, sf_dir):
    text = F.replace(F.replace("s_name", F.lit("#"), F.lit("\u2013")), F.lit("0"), F.lit("\u2022"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", latex.readable(text).alias("tex"))


# --- boxes and pages


@query(f"""
WITH b AS ({BOXES}), n AS (SELECT *, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1 FROM b WINDOW w AS (PARTITION BY page ORDER BY ord)),
o AS (SELECT *, least((x1 - x0) * 0.1::DOUBLE, 0.01::DOUBLE) AS dx, least((y1 - y0) * 0.1::DOUBLE, 0.01::DOUBLE) AS dy, greatest(least(x1, nx1) - greatest(x0, nx0), 0) * greatest(least(y1, ny1) - greatest(y0, ny0), 0) AS o, (nx1 - nx0) * (ny1 - ny0) AS a FROM n)
SELECT vec_id, CASE WHEN nx0 IS NOT NULL THEN round_even(o * 10000 / greatest(1, a * 10000), 5) END AS overlap, round_even(greatest(0, least(1, x0 - dx)), 5) AS px0, round_even(greatest(0, least(1, y1 + dy)), 5) AS py1, round_even(x0 * 1.25::DOUBLE - 0.125::DOUBLE, 5) AS zx0, round_even(y1 * 1.25::DOUBLE + 0.25::DOUBLE, 5) AS zy1,
  round_even(greatest(0, least(1, (x0 - 0.25::DOUBLE) / 0.5::DOUBLE)), 5) AS cx0, round_even(greatest(0, least(1, (y1 - 0.125::DOUBLE) / 0.75::DOUBLE)), 5) AS cy1, round_even(x0, 5) AS tx0, round_even(y1, 5) AS ty1 FROM o
""")
def box_transforms(spark, sf_dir):
    """Overlap with the next box in thousandths of the page, padding, zoom, crop, and boxes from model answers."""
    w = Window.partitionBy("page").orderBy("ord")
    rows = _boxes(spark, sf_dir).select("*", *[F.lead(c).over(w).alias(f"n{c}") for c in ("x0", "y0", "x1", "y1")])
    scaled = lambda prefix: g.Box(*(v * 100 for v in g.box(prefix)))
    padded, zoomed = g.padded(g.box(), 0.1, 0.01), g.zoomed(g.box(), F.lit(1.25), F.lit(-0.125), F.lit(0.25))
    cropped = g.cropped(g.box(), g.Box(F.lit(0.25), F.lit(0.125), F.lit(0.75), F.lit(0.875)))
    answer = g.thousandths(F.array(*[F.col(c) * 1000 for c in ("y0", "x0", "y1", "x1")]))
    r = lambda c, name: F.bround(c, 5).alias(name)
    overlap = F.when(F.col("nx0").isNotNull(), g.overlap_ratio(scaled(""), scaled("n")))
    return rows.select("vec_id", r(overlap, "overlap"), r(padded.x0, "px0"), r(padded.y1, "py1"), r(zoomed.x0, "zx0"), r(zoomed.y1, "zy1"), r(cropped.x0, "cx0"), r(cropped.y1, "cy1"), r(answer.x0, "tx0"), r(answer.y1, "ty1"))


@query(f"""
WITH b AS ({BOXES}), f AS (SELECT page, ord, x0, y0, x1, y1, 'figure' AS label, 1.0::DOUBLE AS confidence, 0 AS k FROM b WHERE label < 3),
t AS (SELECT page, ord, x0, y0, x1, y1, 'textbox' AS label, CASE WHEN vec_id % 2 = 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence, 1 AS k FROM b WHERE label BETWEEN 3 AND 6 AND (x1 - x0) * 600 >= 50 AND (y1 - y0) * 800 >= 20),
c AS (SELECT page, ord, x0, y0, (x1 - x0) * 3 AS w, (y1 - y0) * 2 AS h, vec_id % 9 AS n FROM b WHERE label > 6),
g AS (SELECT page, ord, x0, y0, x0 + w AS x1, y0 + h AS y1, 'table' AS label, 0.85::DOUBLE AS confidence, 2 AS k FROM c WHERE w >= 0.2 AND h >= 0.05 AND n >= 4 AND n / (w * 600 * h * 800 / 10000) >= 0.5 AND greatest(w * 600 / (h * 800), h * 800 / (w * 600)) <= 20),
a AS (SELECT * FROM f UNION ALL SELECT * FROM t UNION ALL SELECT * FROM g)
SELECT page, label, confidence, CAST(row_number() OVER (PARTITION BY page ORDER BY k, ord) AS INTEGER) AS place, round_even(x0, 4) AS x0, round_even(y1, 4) AS y1 FROM a
""")
def heuristic_regions(spark, sf_dir):
    """Boxes as images, drawings and contours of pages of 600 by 800."""
    boxes = _boxes(spark, sf_dir).withColumn("doc_id", F.lit("d")).withColumn("page_width", F.lit(600.0)).withColumn("page_height", F.lit(800.0))
    at = lambda c: (F.col(c) * (600 if c[0] == "x" else 800)).alias(c)
    placed = boxes.select("doc_id", "page", "ord", "label", "vec_id", "page_width", "page_height", at("x0"), at("y0"), at("x1"), at("y1"))
    images, drawings = placed.where("label < 3"), placed.where("label between 3 and 6").withColumn("type", F.when(F.col("vec_id") % 2 == 0, "fs").otherwise("s"))
    contours = placed.where("label > 6").select("doc_id", "page", "ord", "page_width", "page_height", F.col("x0").alias("x"), F.col("y0").alias("y"), ((F.col("x1") - F.col("x0")) * 3).alias("width"), ((F.col("y1") - F.col("y0")) * 2).alias("height"), (F.col("vec_id") % 9).alias("intersections"))
    found = scans.heuristic_regions(images, drawings, contours)
    return found.select("page", "label", "confidence", "place", F.bround("x0", 4).alias("x0"), F.bround("y1", 4).alias("y1"))


@query("""
WITH s AS (SELECT user_id % 40 AS g, user_id % 4 AS k, value / 500 AS v, event_id % 5 + 1 AS w FROM events),
t AS (SELECT g, CASE WHEN k = 0 THEN greatest(0, 1 - v) WHEN k = 1 THEN CASE WHEN w > 2 THEN v / 4 ELSE 0.6::DOUBLE + v / 4 END WHEN k = 2 THEN CASE WHEN w > 3 THEN v / 9 + 0.53::DOUBLE ELSE v / 9 END ELSE CASE WHEN w > 3 THEN 0.88::DOUBLE ELSE v / 9 END END AS x0, k, w FROM s),
q AS (SELECT g, x0, CASE WHEN k = 2 THEN x0 + 0.42::DOUBLE WHEN k = 3 AND w <= 3 THEN x0 + 0.5::DOUBLE ELSE least(1, x0 + w / 50::DOUBLE) END AS x1 FROM t),
bd AS (SELECT g, count(*) AS n, quantile_cont(x0, 0.01) AS l, quantile_cont(x1, 0.99) AS r FROM q GROUP BY g),
c AS (SELECT g, CAST(least(199, greatest(0, floor(x0 * 200))) AS INTEGER) AS b0, CAST(least(199, greatest(0, ceil(x1 * 200))) AS INTEGER) AS b1 FROM q),
e AS (SELECT g, unnest(range(b0, b1)) AS bin FROM c), k AS (SELECT g, bin, count(*) AS n FROM e GROUP BY 1, 2),
a AS (SELECT f.g, b.bin, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT g FROM q) f CROSS JOIN (SELECT unnest(range(0, 200)) AS bin) b LEFT JOIN k ON k.g = f.g AND k.bin = b.bin),
m AS (SELECT *, floor(0.25 * max(n) OVER (PARTITION BY g)) AS lim FROM a), i AS (SELECT *, n <= lim AS low FROM m WHERE bin BETWEEN 20 AND 179),
rn AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM i),
gp AS (SELECT g, min(bin) AS f, max(bin) + 1 AS z FROM rn WHERE low GROUP BY g, run HAVING max(bin) < 179),
x AS (SELECT gp.g, f, greatest(l, f / 200) AS a, least(r, z / 200) AS b, l, r FROM gp JOIN bd ON gp.g = bd.g WHERE n >= 5 AND r > l),
y AS (SELECT g, f, (b - a) / (r - l) AS gap, (a - l) / (r - l) AS before, (a + b) / 2 AS centre FROM x), h AS (SELECT g, arg_max({'gap': gap, 'before': before, 'centre': centre}, {'gap': gap, 'f': -f}) AS s FROM y WHERE gap > 0.007 GROUP BY g),
o AS (SELECT bd.g, s.gap AS gap, s.before AS before, CASE WHEN s.gap IS NULL THEN 'single_column' WHEN s.gap > 0.1 THEN CASE WHEN s.centre > 0.55 THEN 'sidebar_right' ELSE 'sidebar_left' END WHEN s.centre > 0.4 AND s.centre < 0.6 THEN 'two_col_equal' ELSE 'single_column' END AS pattern FROM bd LEFT JOIN h ON h.g = bd.g)
SELECT g, pattern, round_even(CASE pattern WHEN 'single_column' THEN 0 WHEN 'two_col_equal' THEN 0.48 WHEN 'sidebar_left' THEN before ELSE 1 - before - gap END, 5) AS sidebar_share, round_even(CASE pattern WHEN 'single_column' THEN 0 ELSE gap END, 5) AS gap_share,
  round_even(CASE pattern WHEN 'single_column' THEN 1 WHEN 'two_col_equal' THEN 0.48 WHEN 'sidebar_left' THEN 1 - before - gap ELSE before END, 5) AS main_share FROM o
""")
def page_patterns(spark, sf_dir):
    """Users in forty groups as pages of four kinds, their events as spans."""
    k, v, w = F.col("user_id") % 4, F.col("value") / 500, F.col("event_id") % 5 + 1
    x0 = F.when(k == 0, F.greatest(F.lit(0.0), 1 - v)).when(k == 1, F.when(w > 2, v / 4).otherwise(0.6 + v / 4)).when(k == 2, F.when(w > 3, v / 9 + 0.53).otherwise(v / 9)).otherwise(F.when(w > 3, 0.88).otherwise(v / 9))
    x1 = F.when(k == 2, F.col("x0") + 0.42).when((k == 3) & (w <= 3), F.col("x0") + 0.5).otherwise(F.least(F.lit(1.0), F.col("x0") + w / 50))
    spans = table(spark, sf_dir, "events").withColumn("x0", x0).select((F.col("user_id") % 40).alias("g"), "x0", x1.alias("x1"))
    r = lambda c: F.bround(c, 5).alias(c)
    return layout.page_patterns(spans, ["g"]).select("g", "pattern", r("sidebar_share"), r("gap_share"), r("main_share"))


@query(f"WITH b AS ({BOXES}), p AS (SELECT page // 4 AS doc_id, page, count(*) AS n_images FROM b GROUP BY 1, 2) SELECT doc_id, page, n_images, CAST(sum(n_images) OVER (PARTITION BY doc_id) AS BIGINT) AS n_document FROM p")
def image_counts(spark, sf_dir):
    return scans.image_counts(_boxes(spark, sf_dir).select(F.expr("page div 4").alias("doc_id"), "page"))


@query(f"""
WITH b AS ({BOXES}), r AS (SELECT page // 4 AS doc_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY ord) AS found FROM b WHERE page % 4 = 0 GROUP BY 1)
SELECT b.page // 4 AS doc_id, round_even(min(b.x0), 5) AS margin, coalesce(any_value(r.found), '') AS found FROM b LEFT JOIN r ON r.doc_id = b.page // 4 WHERE b.page % 4 = 0 GROUP BY 1
""")
def page_analysis(spark, sf_dir):
    """Four pages to a document; only the first one counts."""
    boxes = _boxes(spark, sf_dir).withColumn("doc_id", F.expr("page div 4")).withColumn("page", F.col("page") % 4)
    styles = boxes.groupBy("doc_id", "page").agg(F.min("x0").alias("margin"))
    found = scans.page_analysis(styles, boxes.select("doc_id", "page", "ord", "label", F.lit(1.0).alias("confidence")))
    return found.select("doc_id", F.bround("margin", 5).alias("margin"), F.array_join(F.transform("regions", lambda r: r["label"].cast("string")), ",").alias("found"))


@query(f"""
WITH b AS ({BOXES}), w AS (SELECT page, ord // 5 AS block, ord % 5 // 2 AS line, ord, 'w' || CAST(label AS VARCHAR) AS word, CASE WHEN label > 1 THEN label / 10 END AS c, x0, y1 FROM b),
l AS (SELECT 'line' AS kind, page, block, line, string_agg(word, ' ' ORDER BY ord) AS text, round_even(coalesce(avg(c), 1), 6) AS confidence, round_even(min(x0), 5) AS x0, round_even(max(y1), 5) AS y1 FROM w GROUP BY 2, 3, 4)
SELECT * FROM l UNION ALL SELECT 'block', page, block, -1, string_agg(word, ' ' ORDER BY line, ord), round_even(coalesce(avg(c), 1), 6), round_even(min(x0), 5), round_even(max(y1), 5) FROM w GROUP BY 2, 3
""")
def ocr_texts(spark, sf_dir):
    """Boxes as OCR words: lines of two, blocks of five."""
    words = _boxes(spark, sf_dir).select(F.lit("d").alias("doc_id"), "page", F.expr("ord div 5").cast("int").alias("block"), F.expr("(ord % 5) div 2").cast("int").alias("line"), "ord", F.concat(F.lit("w"), F.col("label").cast("string")).alias("text"), F.when(F.col("label") > 1, F.col("label") / 10).alias("confidence"), "x0", "y0", "x1", "y1")
    shown = lambda df, kind, line: df.select(F.lit(kind).alias("kind"), "page", "block", line.alias("line"), "text", F.bround("confidence", 6).alias("confidence"), F.bround("x0", 5).alias("x0"), F.bround("y1", 5).alias("y1"))
    return shown(scans.ocr_lines(words), "line", F.col("line")).unionByName(shown(scans.ocr_blocks(words), "block", F.lit(-1)))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN quality WHEN doc_id % 7 <> 1 THEN toxic END, -1) AS score, doc_id % 3 = 0 AS from_cache FROM labels")
def reused_results(spark, sf_dir):
    """Labels as results: of every third row there is an older one, of some there is none at all."""
    rows, key = table(spark, sf_dir, "labels"), F.col("doc_id")
    cached, fresh = rows.where(key % 3 == 0).select("doc_id", F.col("quality").alias("score")), rows.where(key % 7 != 1).select("doc_id", F.col("toxic").alias("score"))
    return scans.reused(rows.select("doc_id"), cached, fresh, ["doc_id"]).select("doc_id", F.coalesce("score", F.lit(-1)).alias("score"), "from_cache")


@query(f"""
WITH b AS (SELECT *, page // 4 AS doc, vec_id AS o FROM ({BOXES})), s AS (SELECT doc, o, page, ord, label, repeat('x', label + 1) AS text, 'font' || CAST(label % 3 AS VARCHAR) AS font, x0 * 600 AS x0, y0 * 300 AS y0, x1 * 600 AS x1 FROM b),
f AS (SELECT doc, font, sum(length(text)) AS w, min(o) AS first FROM s WHERE length(text) > 3 GROUP BY 1, 2), ff AS (SELECT doc, arg_max(font, {{'w': w, 'f': -first}}) AS font FROM f GROUP BY 1),
y AS (SELECT DISTINCT doc, round_even(y0, 1) AS y FROM s), yk AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY y) AS k FROM y), g AS (SELECT doc, y - lag(y) OVER (PARTITION BY doc ORDER BY y) AS gap FROM yk WHERE k <= 50), gg AS (SELECT doc, avg(gap) AS ls FROM g WHERE gap > 8 AND gap < 25 GROUP BY 1)
SELECT s.doc AS doc_id, coalesce(any_value(ff.font), 'Calibri') AS body_font_family, round_even(coalesce(max(CASE WHEN x0 > 300 THEN x1 END), 0), 4) AS right_margin, round_even(coalesce(any_value(gg.ls), 0), 5) AS line_spacing, count(DISTINCT page) AS n_columns, count(*) AS n_regions, count(*) FILTER (WHERE label = 0) AS n_sections
FROM s LEFT JOIN ff ON ff.doc = s.doc LEFT JOIN gg ON gg.doc = s.doc GROUP BY s.doc
""")
def layout_hints(spark, sf_dir):
    """Boxes as spans of documents of four pages."""
    boxes = _boxes(spark, sf_dir).withColumn("doc_id", F.expr("page div 4"))
    spans = boxes.select("doc_id", F.col("vec_id").alias("ord"), "label", F.repeat(F.lit("x"), F.col("label") + 1).alias("text"), F.concat(F.lit("font"), (F.col("label") % 3).cast("string")).alias("font"), (F.col("x0") * 600).alias("x0"), (F.col("y0") * 300).alias("y0"), (F.col("x1") * 600).alias("x1"))
    columns = layout.column_vote(boxes, ["doc_id", "page"])
    regions = boxes.select("doc_id", "page", "ord", F.col("label").cast("string").alias("label"), F.lit(1.0).alias("confidence"), F.lit("ml").alias("source"))
    hints = scans.layout_hints(spans, columns, regions, F.col("x0") > 300, F.col("label") == 0)
    packed = scans.with_hints(boxes.select("doc_id").distinct(), hints)
    size = lambda c: F.size(f"hints.{c}").cast("long")
    return packed.select("doc_id", "hints.body_font_family", F.bround("hints.right_margin", 4).alias("right_margin"), F.bround("hints.line_spacing", 5).alias("line_spacing"), size("columns").alias("n_columns"), size("regions").alias("n_regions"), size("section_positions").alias("n_sections"))


@query("""
WITH s AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS ord, l_returnflag || l_linestatus AS font, CAST(l_quantity AS INTEGER) AS n FROM lineitem WHERE l_quantity > 3),
f AS (SELECT l_orderkey, font, sum(n) AS w, min(ord) AS first FROM s GROUP BY 1, 2) SELECT l_orderkey, arg_max(font, {'w': w, 'f': -first}) AS font FROM f GROUP BY 1
""")
def dominant_fonts(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("font"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    return layout.dominant_font(spans, ["l_orderkey"])


@query(f"""
WITH b AS ({BOXES}), s AS (SELECT page // 4 AS doc_id, CASE WHEN label % 2 = 0 THEN 'ref' ELSE 'gen' END AS side, page % 4 AS page, ord // 3 AS block, ord, label + 8.0::DOUBLE AS fs, y0 * 100 AS y0, y1 * 100 AS y1 FROM b WHERE page % 4 < 3),
w AS (SELECT *, y0 - lag(y0) OVER bl AS line, CASE WHEN lag(block) OVER pg <> block THEN y0 - lag(y1) OVER pg END AS jump FROM s WINDOW bl AS (PARTITION BY doc_id, side, page, block ORDER BY ord), pg AS (PARTITION BY doc_id, side, page ORDER BY ord))
SELECT doc_id, side, round_even(avg(fs), 5) AS font_size, round_even(avg(CASE WHEN line > 5 AND line < 30 THEN line END), 5) AS line_gap, round_even(avg(CASE WHEN jump > 0 AND jump < 100 THEN jump END), 5) AS block_gap, max(page) + 1 AS pages FROM w GROUP BY 1, 2
""")
def page_metrics(spark, sf_dir):
    """Boxes as spans of two sides of documents of four pages."""
    spans = _boxes(spark, sf_dir).select(F.expr("page div 4").alias("doc_id"), F.when(F.col("label") % 2 == 0, "ref").otherwise("gen").alias("side"), (F.col("page") % 4).alias("page"), F.expr("ord div 3").alias("block"), "ord", (F.col("label") + 8.0).alias("font_size"), (F.col("y0") * 100).alias("y0"), (F.col("y1") * 100).alias("y1"))
    r = lambda c: F.bround(c, 5).alias(c)
    return layout.page_metrics(spans).select("doc_id", "side", r("font_size"), r("line_gap"), r("block_gap"), "pages")


@query(f"""
WITH b AS ({BOXES}), h AS (SELECT page, arg_min({{'y0': y0, 'y1': y1}}, {{'c': -(0.5::DOUBLE + label / 20), 'y': y0}}) AS h FROM b WHERE 0.5::DOUBLE + label / 20 >= 0.6 AND y0 <= 0.35 GROUP BY page)
SELECT page, round_even(h.y0, 5) AS y0, round_even(least(1, h.y1 + 0.02::DOUBLE, h.y0 + 0.5::DOUBLE), 5) AS y1 FROM h WHERE h.y1 - h.y0 BETWEEN 0.08 AND 0.5
""")
def header_regions(spark, sf_dir):
    regions = _boxes(spark, sf_dir).select(F.col("page").alias("doc_id"), F.lit("Header").alias("label"), (0.5 + F.col("label") / 20).alias("confidence"), "y0", "y1")
    return corrections.header_region(regions).select(F.col("doc_id").alias("page"), F.bround("y0", 5).alias("y0"), F.bround("y1", 5).alias("y1"))


@query("""
WITH r AS (SELECT l_orderkey, l_suppkey % 2 AS g, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, CASE WHEN l_quantity > 45 THEN NULL ELSE CAST(l_quantity * 100 AS BIGINT) END AS h, l_returnflag = 'R' AS head, l_orderkey % 9 = 0 AS only_ FROM lineitem),
f AS (SELECT l_orderkey, min(g) AS g FROM r GROUP BY 1), x AS (SELECT r.*, min(CASE WHEN head THEN i END) OVER (PARTITION BY l_orderkey) AS stop FROM r JOIN f USING (l_orderkey, g)),
s AS (SELECT l_orderkey, sum(CASE WHEN only_ OR i < stop THEN coalesce(h, 0) END) AS twips FROM x GROUP BY 1),
v AS (SELECT l_orderkey, CASE WHEN twips > 0 THEN twips / 1440 / 11.0::DOUBLE END AS ratio FROM s),
w AS (SELECT l_orderkey, ratio, CASE WHEN l_orderkey % 4 = 0 THEN 0.1::DOUBLE ELSE 0 END AS y0, CASE WHEN l_orderkey % 4 = 0 THEN 0.3::DOUBLE ELSE coalesce(ratio, 0.25) END AS y1 FROM v WHERE l_orderkey % 5 <> 0)
SELECT l_orderkey, round_even(ratio, 6) AS grid, round_even(least(1, y1 + 0.02::DOUBLE, y0 + 0.5::DOUBLE) - y0, 6) AS ratio, CASE WHEN l_orderkey % 4 = 0 THEN 'detected' WHEN ratio IS NOT NULL THEN 'grid' ELSE 'default' END AS source FROM w
""")
def header_fallbacks(spark, sf_dir):
    """Orders as documents with grids of two tables; every fifth is no CV, of every fourth a header is detected."""
    key = F.col("l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey", F.col("l_suppkey") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = table(spark, sf_dir, "lineitem").select(key.alias("doc_id"), (F.col("l_suppkey") % 2).alias("table_id"), place.alias("row_idx"), F.when(F.col("l_quantity") <= 45, (F.col("l_quantity") * 100).cast("long")).alias("height"), (F.col("l_returnflag") == "R").alias("is_heading"), (key % 9 == 0).alias("header_only"))
    docs = rows.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 5 == 0, "default").otherwise("resume").alias("doc_type"), F.lit(11.0).alias("page_height"), F.lit(True).alias("is_complex"))
    grid = header.grid_header_ratio(rows, docs)
    detected = docs.where("doc_id % 4 = 0").select("doc_id", F.lit(0.1).alias("y0"), F.lit(0.3).alias("y1"))
    found = header.header_fallbacks(docs, detected, grid).join(grid.withColumnRenamed("ratio", "grid"), "doc_id")
    return found.select(F.col("doc_id").alias("l_orderkey"), F.bround("grid", 6).alias("grid"), F.bround("ratio", 6).alias("ratio"), "source")


@query("""
WITH c AS (SELECT conv_id, CAST(turn AS DOUBLE) AS ord, CASE WHEN turn % 6 = 5 THEN 'header' ELSE 'body' END AS scope, CASE WHEN turn % 4 = 3 THEN 'layout_grid' ELSE 'paragraph' END AS kind, turn < 2 AS contact FROM conversations),
f AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0), k AS (SELECT c.* FROM c LEFT JOIN f USING (conv_id) WHERE f.conv_id IS NULL OR (scope = 'body' AND NOT contact)),
p AS (SELECT f.conv_id, coalesce(min(CASE WHEN kind = 'layout_grid' THEN ord END), min(ord), 0) - 0.5 AS ord FROM f LEFT JOIN k USING (conv_id) GROUP BY 1)
SELECT conv_id, ord, scope, kind AS block_type FROM k UNION ALL SELECT conv_id, CAST(ord AS DOUBLE), 'body', 'figure' FROM p
""")
def header_figures(spark, sf_dir):
    """Conversations as documents: the first two turns are contact lines, every third document keeps its header."""
    turn = F.col("turn")
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("ord"), F.when(turn % 6 == 5, "header").otherwise("body").alias("scope"), F.when(turn % 4 == 3, "layout_grid").otherwise("paragraph").alias("block_type"), "text")
    found = header.with_header_figure(blocks, blocks.where("doc_id % 3 <> 0").select("doc_id").distinct(), F.col("ord") < 2)
    return found.select(F.col("doc_id").alias("conv_id"), "ord", "scope", "block_type")


@query(r"""
WITH p AS (SELECT conv_id, turn, role, i, trim(regexp_replace(lower(parts[i]), '\s+', ' ', 'g')) AS line FROM (SELECT conv_id, turn, role, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS parts FROM conversations))),
w AS (SELECT conv_id, turn * 1000 + i AS ord, role, line, list_distinct(list_filter(string_split(line, ' '), lambda x: x <> '')) AS ws FROM p),
m AS (SELECT a.conv_id, a.ord, r.ord AS best, CASE WHEN a.line = r.line THEN 1 WHEN contains(a.line, r.line) OR contains(r.line, a.line) THEN 0.95::DOUBLE ELSE len(list_intersect(a.ws, r.ws)) / (len(a.ws) + len(r.ws) - len(list_intersect(a.ws, r.ws))) END AS score
  FROM w a JOIN w r ON a.conv_id = r.conv_id AND a.role = 'assistant' AND r.role = 'user' AND a.line <> '' AND r.line <> ''),
b AS (SELECT conv_id, ord, arg_max(best, {'s': score, 'o': -best}) AS best, max(score) AS score FROM m WHERE score > 0 GROUP BY 1, 2)
SELECT w.conv_id, w.ord, coalesce(b.best, -1) AS best, round_even(coalesce(b.score, 0), 6) AS score FROM w LEFT JOIN b ON b.conv_id = w.conv_id AND b.ord = w.ord WHERE w.role = 'assistant'
""")
def spilled_lines(spark, sf_dir):
    """For each line of an answer the most similar line of the conversation's user."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    rows = rows.withColumn("ord", F.col("turn") * 1000 + F.col("i") + 1)
    found = pagination.best_matches(rows.where("role = 'assistant'"), rows.where("role = 'user'"))
    return found.select(F.col("doc_id").alias("conv_id"), "ord", F.coalesce("best", F.lit(-1)).alias("best"), F.bround("score", 6).alias("score"))


@query(f"""
WITH b AS ({BOXES}), l AS (SELECT page, ord, CASE WHEN label = 4 THEN ' ' || chr(173) ELSE ' text  ' || CAST(label AS VARCHAR) END AS text, x0, y0 FROM b)
SELECT page, trim(regexp_replace(text, ' +', ' ', 'g')) AS text, CAST(row_number() OVER (PARTITION BY page ORDER BY round_even(y0 * 100, 1), x0) AS INTEGER) AS line FROM l WHERE text <> ' ' || chr(173)
""")
def page_lines(spark, sf_dir):
    text = F.when(F.col("label") == 4, " \u00ad").otherwise(F.concat(F.lit(" text  "), F.col("label").cast("string")))
    rows = _boxes(spark, sf_dir).select(F.lit("d").alias("doc_id"), "page", text.alias("text"), "x0", (F.col("y0") * 100).alias("y0"))
    return pagination.page_lines(rows).select("page", "text", "line")


# --- corrections, drift, reports


@query("""
WITH e AS (SELECT user_id, max(value) AS most, avg(value) AS mean FROM events GROUP BY user_id) SELECT user_id, concat_ws(',', CASE WHEN most > 100 THEN 'MAX_DRIFT' END, CASE WHEN mean > 50 THEN 'AVG_DRIFT' END) AS warnings FROM e
""")
def drift_warnings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("most"), F.avg("value").alias("mean"))
    return rows.select("user_id", F.array_join(drift.drift_warnings(F.col("most"), F.col("mean")), ",").alias("warnings"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS cur, (p_partkey % 11 - 5) / 100 AS dy, CASE WHEN p_partkey % 3 = 0 THEN 1.5::DOUBLE ELSE 1 END AS f, 0.9::DOUBLE + p_partkey % 7 / 20 AS ratio, 8 + p_partkey % 5 AS size FROM part), w AS (SELECT *, greatest(0, cur - dy * 792 * 0.5::DOUBLE * f) AS wanted FROM p)
SELECT p_partkey, CASE WHEN abs(wanted - cur) > 1 THEN trunc(wanted) ELSE cur END::DOUBLE AS spacing, round_even(CASE WHEN ratio > 1.05 THEN greatest(8, least(12, size / ratio)) ELSE size END, 5)::DOUBLE AS font FROM w
""")
def block_corrections(spark, sf_dir):
    key = F.col("p_partkey")
    spacing = drift.corrected_block_spacing(F.col("p_size").cast("double"), (key % 11 - 5) / 100, F.when(key % 3 == 0, "Title").otherwise("Text"))
    font = corrections.font_correction(0.9 + key % 7 / 20, (8 + key % 5).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", spacing.alias("spacing"), F.bround(font, 5).alias("font"))


@query("""
WITH d AS (SELECT user_id, count(*) FILTER (WHERE event_id % 3 = 0 AND event_id % 2 = 0 AND event_id % 5 <> 0) AS n FROM events GROUP BY 1) SELECT user_id, n AS n_missing FROM d WHERE n >= 2
""")
def numbering_wanted(spark, sf_dir):
    key = F.col("event_id")
    diffs = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.when(key % 3 == 0, "missing").otherwise("extra").alias("diff_type"), (key % 2 == 0).alias("has_numbering"), F.lit(True).alias("is_heading_like"), F.when(key % 5 == 0, 0.5).otherwise(1.0).alias("confidence"))
    return corrections.numbering_wanted(diffs).select(F.col("doc_id").alias("user_id"), "n_missing")


@query("""
WITH h AS (SELECT p_partkey // 7 AS doc_id, (['Work Experience', 'Related work', 'SKILLS', 'Introduction', 'Nothing', 'Appendix A', 'My contact'])[p_partkey % 7 + 1] AS text FROM part WHERE p_size % 3 = 0),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE text IN ('Related work', 'Introduction', 'Appendix A')) AS a FROM h GROUP BY 1), k AS (SELECT DISTINCT p_partkey // 7 AS doc_id, p_partkey // 7 % 2 + 1 AS columns FROM part)
SELECT doc_id, (columns > 1 AND coalesce(n, 0) >= 2) OR coalesce(a, 0) >= 3 AS numbered FROM k LEFT JOIN c USING (doc_id)
""")
def numbered_sections(spark, sf_dir):
    doc = F.expr("p_partkey div 7").alias("doc_id")
    rows = table(spark, sf_dir, "part").select(doc, _pick(("Work Experience", "Related work", "SKILLS", "Introduction", "Nothing", "Appendix A", "My contact"), F.col("p_partkey")).alias("text"), (F.col("p_size") % 3 + 1).alias("level"))
    columns = rows.select("doc_id").distinct().withColumn("columns", F.col("doc_id") % 2 + 1)
    return corrections.numbered_sections(rows.where("level = 1"), columns)


@query("""
WITH o AS (SELECT p_type, lower(p_name) AS k, arg_max(p_size % 4 + 1, p_partkey) AS level FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2)
SELECT p_partkey, coalesce(o.level, 3) AS level FROM part LEFT JOIN o ON o.p_type = part.p_type AND o.k = lower(p_name) WHERE p_partkey % 2 = 1
""")
def corrected_levels(spark, sf_dir):
    """Odd parts as headings, even ones as the reference's outline, with section numbers."""
    rows = table(spark, sf_dir, "part").withColumnRenamed("p_type", "doc_id").withColumn("ord", F.col("p_partkey"))
    headings = rows.where("ord % 2 = 1").select("doc_id", "ord", F.col("p_name").alias("text"), F.lit(3).alias("level"))
    outline = rows.where("ord % 2 = 0").select("doc_id", "ord", F.concat(F.lit("2.1 "), F.upper("p_name")).alias("title"), (F.col("p_size") % 4 + 1).alias("level"))
    return corrections.corrected_levels(headings, outline).select(F.col("ord").alias("p_partkey"), "level")


@query("""
WITH b AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1), m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P')
SELECT o_custkey, last + k AS ord, 'Recovered table (Page ' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || ')' AS caption FROM m JOIN b USING (o_custkey)
""")
def recovered_figures(spark, sf_dir):
    """Pending orders as regions that are missing: figures behind the customer's other blocks."""
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    blocks = rows.select("doc_id", F.col("o_orderkey").alias("ord"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("double").alias("width"))
    diffs = rows.where("o_orderstatus = 'P'").select("doc_id", F.col("o_orderkey").alias("diff_id"), F.lit("table").alias("ref_block_type"), (F.col("o_orderkey") % 9).cast("int").alias("ref_page"))
    found = corrections.recovered_figures(blocks, diffs).where("block_type = 'figure' and width = 6.0")
    return found.select(F.col("doc_id").alias("o_custkey"), "ord", "caption")


@query("""
WITH s AS (SELECT user_id, max(value) AS spacing FROM events GROUP BY 1), a AS (SELECT user_id, CASE WHEN spacing > 150 THEN spacing / 2 ELSE spacing END AS spacing, spacing > 150 AS f FROM s), b AS (SELECT user_id, CASE WHEN spacing > 90 THEN spacing - 10 ELSE spacing END AS spacing, f, spacing > 90 AS g FROM a)
SELECT user_id, round_even(spacing, 6) AS spacing, concat_ws(',', CASE WHEN f THEN 'pagination' END, CASE WHEN g THEN 'local' END) AS fixes FROM b
""")
def applied_corrections(spark, sf_dir):
    """Two rules, named in the wrong order, apply in the fixed one: the second sees what the first has changed."""

    def rule(limit, change, name):
        def run(state):
            return state.withColumn("spacing", F.when(F.col("spacing") > limit, change(F.col("spacing"))).otherwise(F.col("spacing"))), state.where(F.col("spacing") > limit).select("doc_id", F.lit(name).alias("fix"))

        return run

    state = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("value").alias("spacing"))
    state, fixes = corrections.applied(state, {"local": rule(90, lambda c: c - 10, "local"), "pagination": rule(150, lambda c: c / 2, "pagination")})
    told = fixes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "fix"))), lambda s: s["fix"]), ",").alias("fixes"))
    return state.join(told, "doc_id", "left").select(F.col("doc_id").alias("user_id"), F.bround("spacing", 6).alias("spacing"), F.coalesce("fixes", F.lit("")).alias("fixes"))


@query("""
WITH o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 8.5::DOUBLE END AS font_size, CASE WHEN s_suppkey % 5 = 0 THEN 0.5::DOUBLE END AS squeeze FROM supplier)
SELECT s_suppkey, coalesce(font_size, 10.5) AS font_size, 1.0::DOUBLE AS line_spacing, coalesce(squeeze, 1.0) AS squeeze FROM o
""")
def overridden_profiles(spark, sf_dir):
    """Suppliers as CVs, some with settings of their own."""
    key = F.col("s_suppkey")
    ids = table(spark, sf_dir, "supplier").select(key.alias("doc_id"))
    docs = ids.select("doc_id", F.lit("resume").alias("doc_type"), F.lit(None).cast("double").alias("font_size"), F.lit(None).cast("double").alias("section_spacing"))
    own = ids.where("doc_id % 3 = 0").select("doc_id", F.lit("font_size").alias("param"), F.lit(8.5).alias("value")).unionAll(ids.where("doc_id % 5 = 0").select("doc_id", F.lit("squeeze").alias("param"), F.lit(0.5).alias("value")))
    found = calibration.overridden(calibration.calibrated(docs, calibration.profiles(spark)), own)
    return found.select(F.col("doc_id").alias("s_suppkey"), "font_size", "line_spacing", "squeeze")


@query("SELECT p_partkey, round_even(CASE WHEN p_partkey % 4 = 0 OR p_size % 5 = 0 THEN 1.15 ELSE p_retailprice / p_size END, 5)::DOUBLE AS spacing FROM part")
def measured_spacings(spark, sf_dir):
    """Parts as pages: some are being squeezed, some have no font size."""
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    spacing = calibration.measured_spacing(F.col("p_retailprice"), size, F.when(F.col("p_partkey") % 4 == 0, 0.9).otherwise(1.0), F.lit(1.15))
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(spacing, 5).alias("spacing"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_returnflag = 'R' AS tab FROM lineitem),
g AS (SELECT *, sum(CASE WHEN tab THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING) AS seg FROM s),
t AS (SELECT l_orderkey, CAST(seg AS BIGINT) AS segment, string_agg(CAST(l_linenumber AS VARCHAR), '' ORDER BY ord) AS text FROM g WHERE NOT tab GROUP BY 1, 2)
SELECT l_orderkey, segment, text, CASE WHEN segment BETWEEN 1 AND 3 THEN CAST(segment * 100 AS INTEGER) ELSE -1 END AS x FROM t
""")
def tab_segments(spark, sf_dir):
    """Orders as paragraphs, returned items as tabs, with three stops each."""
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    spans = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("block"), order.alias("ord"), F.col("l_linenumber").cast("string").alias("text"), (F.col("l_returnflag") == "R").alias("is_tab"))
    stops = spans.select("doc_id", "block").distinct().select("doc_id", "block", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).withColumn("position", F.col("k") * 100)
    return calibration.tab_segments(spans, stops).select(F.col("block").alias("l_orderkey"), "segment", "text", F.coalesce("x", F.lit(-1)).alias("x"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn % 2 = 0) AS sidebar, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE turn % 2 = 1) AS main FROM conversations GROUP BY conv_id")
def sidebar_split(spark, sf_dir):
    """Conversations as grids of two columns."""
    cells = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("row_idx"), (F.col("turn") % 2).alias("cell_idx"), "text")
    return calibration.sidebar_split(cells, F.lit(True)).withColumnRenamed("doc_id", "conv_id")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'title' ELSE 'text' END AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE label = 'table') AS n_table, count(*) FILTER (WHERE label = 'title') AS n_title, count(*) FILTER (WHERE label = 'text') AS n_text, string_agg(label, ',' ORDER BY k) FILTER (WHERE k <= 5) AS head FROM r GROUP BY 1
""")
def region_summary(spark, sf_dir):
    regions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), _pick(("TABLE", "Title", "strange", "Text"), F.col("o_orderkey")).alias("label"))
    found = calibration.region_summary(regions, ("table", "title", "text"), 5)
    n = lambda k: F.coalesce(F.try_element_at("by_label", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return found.select(F.col("doc_id").alias("o_custkey"), n("table"), n("title"), n("text"), F.array_join(F.transform("head", lambda s: s["label"]), ",").alias("head"))


@query("""
SELECT 'a_' || CAST(c_custkey AS VARCHAR) || '.png' AS file_name, c_nationkey AS class_id FROM customer UNION ALL SELECT 'b_' || CAST(s_suppkey AS VARCHAR) || '.png', s_nationkey FROM supplier
""")
def merged_datasets(spark, sf_dir):
    files = lambda name, key, label: table(spark, sf_dir, name).select(F.concat(F.col(key).cast("string"), F.lit(".png")).alias("file_name"), F.col(label).alias("class_id"))
    return calibration.merged_datasets({"b": files("supplier", "s_suppkey", "s_nationkey"), "a": files("customer", "c_custkey", "c_nationkey")})


@query("""
SELECT '/i/' || CAST(c_custkey AS VARCHAR) || '.png' AS path, CASE WHEN s_suppkey IS NOT NULL THEN '/l/' || CAST(s_suppkey AS VARCHAR) || '.txt' END AS label_path FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def images_with_labels(spark, sf_dir):
    path = lambda name, key, a, b: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(key).cast("string"), F.lit(b)).alias("path"))
    return calibration.images_with_labels(path("customer", "c_custkey", "/i/", ".png"), path("supplier", "s_suppkey", "/l/", ".txt")).select("path", "label_path")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 6 THEN l_linenumber * 2 END AS class_id, l_extendedprice AS x, l_quantity AS y, l_discount * 1000 AS w, l_tax * 1000 AS h FROM lineitem WHERE l_quantity <= 45)
SELECT l_orderkey, class_id, round_even((x + w / 2) / 1000, 5) AS cx, round_even((y + h / 2) / 2000, 5) AS cy, round_even(w / 1000, 5) AS w, round_even(h / 2000, 5) AS h FROM a WHERE class_id IS NOT NULL
""")
def publaynet_labels(spark, sf_dir):
    """Orders as page images, their items as annotations; some have no box, some no class."""
    whole = F.col("l_quantity") <= 45
    one = F.struct(F.col("l_linenumber").alias("category_id"), F.when(whole, F.array(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_tax") * 1000)).alias("bbox"))
    samples = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(one).alias("annotations")).select(F.col("l_orderkey").cast("string").alias("file_name"), F.lit(1000).alias("width"), F.lit(2000).alias("height"), "annotations")
    found = labels.publaynet(samples, spark.createDataFrame([(k, 2 * k) for k in range(6)], "category_id int, class_id int"))
    r = lambda c: F.bround(c, 5).alias(c)
    return found.select(F.col("file_name").cast("long").alias("l_orderkey"), "class_id", r("cx"), r("cy"), r("w"), r("h"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS images, count(*) FILTER (WHERE l_linenumber < 6) AS annotations FROM lineitem GROUP BY 1")
def annotation_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").cast("string").alias("file_name"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("class_id"))
    return scans.annotation_counts(rows, ["l_returnflag"])


@query("""
WITH b AS (SELECT 'part.' || p_type || '.' || CAST(p_partkey AS VARCHAR) AS path, CAST(p_size AS VARCHAR) AS value, p_type, p_partkey FROM part)
SELECT path, CASE WHEN p_partkey % 4 = 0 THEN 'own' ELSE value END AS value FROM b WHERE p_type <> 'SMALL' UNION ALL SELECT 'part.SMALL', 'none' UNION ALL SELECT 'new.path', '1'
""")
def merged_settings(spark, sf_dir):
    """Parts as settings: some values are overridden, one branch is replaced by a value, one path is new."""
    path = F.concat_ws(".", F.lit("part"), "p_type", F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part")
    base = rows.select(path.alias("path"), F.col("p_size").cast("string").alias("value"))
    own = rows.where("p_partkey % 4 = 0 and p_type <> 'SMALL'").select(path.alias("path"), F.lit("own").alias("value"))
    return scans.merged_settings(base, own.unionAll(spark.createDataFrame([("part.SMALL", "none"), ("new.path", "1")], "path string, value string")))


@query("SELECT s_suppkey, round_even(s_acctbal / 7, 4) AS a, round_even(s_acctbal / 7, 1) AS b, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def rounded_reports(spark, sf_dir):
    """Reports as JSON and back, with numbers as they are printed."""
    x = F.col("s_acctbal") / 7
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("a"), x.alias("b"), F.col("s_nationkey").cast("string").alias("nation"))
    json = reports.as_json(reports.rounded(rows, {"a": 4, "b": 1}), "s_suppkey")
    return json.select("s_suppkey", F.from_json("json", "a double, b double, nation string").alias("j")).select("s_suppkey", "j.*")


@query("SELECT n_nationkey, 'path: /d/' || n_name || chr(10) || 'train: images/train' || chr(10) || 'val: images/val' || chr(10) || 'nc: 2' || chr(10) || 'names:' || chr(10) || '  0: text' || chr(10) || '  1: table' || chr(10) AS yaml FROM nation")
def dataset_yaml(spark, sf_dir):
    sets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), F.concat(F.lit("/d/"), "n_name").alias("path"))
    return reports.dataset_yaml(sets, ["text", "table"]).select(F.col("name").alias("n_nationkey"), "yaml")


@query("""
WITH w AS (SELECT conv_id, turn, role, lower(trim(text)) AS t, list_distinct(list_filter(string_split(regexp_replace(lower(trim(text)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), lambda x: x <> '')) AS ws FROM conversations),
m AS (SELECT a.conv_id, a.turn, b.turn AS best, CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0 ELSE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) END AS score FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.role = 'assistant' AND b.role = 'user'),
x AS (SELECT conv_id, turn, arg_max(best, {'s': score, 'o': -best}) AS best, max(score) AS score FROM m GROUP BY 1, 2)
SELECT w.conv_id, w.turn, CASE WHEN x.score >= 0.1 THEN x.best ELSE -1 END AS best, round_even(coalesce(x.score, 0), 6) AS score FROM w LEFT JOIN x ON x.conv_id = w.conv_id AND x.turn = w.turn WHERE w.role = 'assistant'
""")
def block_of_line(spark, sf_dir):
    """For each answer the turn of the conversation's user that shares most words, from a tenth on."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role", "text")
    found = pagination.best_matches(rows.where("role = 'assistant'"), rows.where("role = 'user'"), inside=None, least=0.1)
    return found.select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), F.coalesce("best", F.lit(-1)).alias("best"), F.bround("score", 6).alias("score"))
