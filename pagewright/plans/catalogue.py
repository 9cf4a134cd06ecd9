"""The queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import geometry as g
from pagewright.functions import text as t
from pagewright.operators import documents as d
from pagewright.operators import drift, layout, matching, scans
from pagewright.plans.registry import ORACLE_SQL, QUERIES, query, table
from pagewright.sources import labels
from pagewright.streaming import cooldown


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per line with text: doc_id, ord, line."""
    parts = docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return parts.where(F.length("line") > 0)


LINES = "SELECT doc_id, source, i - 1 AS ord, parts[i] AS line FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)) WHERE length(parts[i]) > 0"
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))"


# --- text


@query(r"SELECT doc_id, trim(regexp_replace(translate(text, chr(173) || chr(8203) || chr(65279), ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS norm FROM documents")
def doc_normalize(spark, sf_dir):
    text = t.collapse(t.drop_invisible(F.col("text")), t.ASCII_SPACE)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("norm"))


@query()
def doc_nfkc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.normalised(F.col("text")).alias("norm"))


@query(f"""
WITH l AS ({LINES}), f AS (
  SELECT doc_id, line, regexp_matches(lower(line), '{"|".join(t.HEADING_KEYWORDS)}')
    OR (regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '\\p{{Ll}}') AND length(line) < 50)
    OR regexp_matches(line, '^[IVX]+\\.\\s*') OR regexp_matches(line, '^[A-Z]\\.\\s*') AS heading,
    regexp_matches(line, '^[IVX]+\\.\\s*') OR regexp_matches(line, '^[A-Z]\\.\\s*') OR regexp_matches(line, '^\\d+[.)]\\s*') AS numbered FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE heading) AS n_heading, count(*) FILTER (WHERE numbered) AS n_numbered FROM f GROUP BY doc_id
""")
def heading_like_lines(spark, sf_dir):
    """Counted inside each document's row, so nothing is shuffled."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0).alias("lines"))
    counted = lambda f: F.size(F.filter("lines", f)).cast("long")
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), counted(t.is_heading_like).alias("n_heading"), counted(t.has_numbering).alias("n_numbered")).where("n_lines > 0")


@query(f"""
WITH l AS ({LINES}), s AS (
  SELECT doc_id, sum(CASE WHEN regexp_matches(trim(lower(line)), '{"|".join(d.ACADEMIC_HEADINGS)}') THEN CASE WHEN ord = 0 THEN 2 ELSE 1 END ELSE 0 END) AS a,
    sum(CASE WHEN regexp_matches(trim(lower(line)), '{"|".join(d.RESUME_HEADINGS)}') THEN CASE WHEN ord = 0 THEN 2 ELSE 1 END ELSE 0 END) AS r, count(*) AS n
  FROM l GROUP BY doc_id)
SELECT doc_id, CAST(a AS BIGINT) AS academic_score, CAST(r AS BIGINT) AS resume_score, n AS n_headings,
  CASE WHEN n % 2 = 0 AND a >= 2 THEN 'academic_twocol' WHEN a >= 4 THEN 'academic_singlecol' WHEN r >= 3 THEN 'resume' WHEN a > r THEN 'academic_singlecol' ELSE 'default' END AS doc_type
FROM s
""")
def doc_type_score(spark, sf_dir):
    """All lines of all documents as headings, the first one on level 1."""
    headings = lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line").alias("text"), F.when(F.col("ord") == 0, 1).otherwise(2).alias("level"))
    scores = d.type_scores(headings)
    kind = d.document_type(F.when(F.col("n_headings") % 2 == 0, 2).otherwise(1), F.col("academic_score"), F.col("resume_score"), F.lit(0))
    return scores.withColumn("doc_type", kind)


@query("""
WITH p AS (SELECT p_partkey, ['Work Experience', 'Related work', 'SKILLS', 'Introduction', 'The education of all', 'Appendix A', 'My contact'][p_partkey % 7 + 1] AS text, p_size % 3 + 1 AS level, p_partkey // 7 AS doc_id FROM part),
w AS (SELECT doc_id, CASE WHEN level = 1 THEN 2 ELSE 1 END AS points, lower(text) IN ('related work', 'introduction', 'appendix a') AS a, lower(text) IN ('work experience', 'skills', 'the education of all', 'my contact') AS r FROM p)
SELECT doc_id, CAST(sum(CASE WHEN a THEN points ELSE 0 END) AS BIGINT) AS academic_score, CAST(sum(CASE WHEN r THEN points ELSE 0 END) AS BIGINT) AS resume_score, count(*) AS n_headings FROM w GROUP BY doc_id
""")
def heading_scores(spark, sf_dir):
    """Parts as headings of seven to a document."""
    names = F.array(*[F.lit(s) for s in ("Work Experience", "Related work", "SKILLS", "Introduction", "The education of all", "Appendix A", "My contact")])
    key = F.col("p_partkey")
    return d.type_scores(table(spark, sf_dir, "part").select(F.expr("p_partkey div 7").alias("doc_id"), names[(key % 7).cast("int")].alias("text"), (F.col("p_size") % 3 + 1).alias("level")))


@query(f"""
WITH c AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE role = 'user'), '') AS a, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS b FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, {WORDS.format('a')} AS r, {WORDS.format('b')} AS g FROM c), n AS (SELECT conv_id, CAST(len(r) AS INTEGER) AS n_ref, CAST(len(list_intersect(r, g)) AS INTEGER) AS n_found, CAST(len(g) AS INTEGER) AS n_gen FROM p)
SELECT conv_id, n_ref, n_found, n_ref - n_found AS n_missing, n_gen - n_found AS n_extra, round_even(CASE WHEN n_ref > 0 THEN n_found / n_ref ELSE 0 END, 6) AS coverage FROM n
""")
def word_coverage(spark, sf_dir):
    """Of the words that a conversation's user takes, those that its answers take, too."""
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda s: s["text"]), "\n").alias(role)
    pairs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said("user"), said("assistant"))
    return matching.word_coverage(pairs, "user", "assistant").select("conv_id", "n_ref", "n_found", "n_missing", "n_extra", F.bround("coverage", 6).alias("coverage"))


@query(f"""
WITH p AS (SELECT conv_id, turn, trim(lower(text)) AS a, trim(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text))) AS c FROM conversations UNION ALL
  SELECT -1 - item_id, 0, trim(lower(text)), trim(lower(left(text, length(text) // 2))) FROM benchmark),
w AS (SELECT *, {WORDS.format('a')} AS wa, {WORDS.format('c')} AS wc FROM p WHERE c IS NOT NULL)
SELECT conv_id, turn, round_even(CASE WHEN a = '' OR c = '' THEN 0 WHEN a = c THEN 1 WHEN contains(a, c) OR contains(c, a) THEN least(length(a), length(c)) / greatest(length(a), length(c))
  WHEN len(wa) = 0 OR len(wc) = 0 THEN 0 ELSE len(list_intersect(wa, wc)) / (len(wa) + len(wc) - len(list_intersect(wa, wc))) END, 6) AS similarity FROM w
""")
def text_similarity(spark, sf_dir):
    """Each turn of a conversation with the next one, and each benchmark item with its first half."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("other"))
    half = F.expr("left(text, length(text) div 2)")
    items = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text", half.alias("other"))
    pairs = turns.unionByName(items).where(F.col("other").isNotNull())
    return pairs.select("conv_id", "turn", F.bround(t.containing_similarity(F.col("text"), F.col("other")), 6).alias("similarity"))


PARTS = "list_filter(regexp_split_to_array({0}, '[.\\n]+ ?'), lambda x: length(x) > 10)"


@query(f"""
WITH l AS (SELECT doc_id, unnest({PARTS.format('text')}) AS part FROM documents), b AS (SELECT DISTINCT unnest({PARTS.format('text')}) AS part FROM benchmark),
m AS (SELECT doc_id, count(*) AS n_parts, count(b.part) AS n_matched FROM l LEFT JOIN b USING (part) GROUP BY doc_id)
SELECT doc_id, n_parts, n_matched, round_even(n_matched / n_parts, 6) AS match_rate,
  CASE WHEN n_parts < greatest(10, floor(0.1 * n_parts)) THEN 'INVALID_EXTRACTION' WHEN n_matched / n_parts <= 0.2 THEN 'INVALID_MATCH_COVERAGE' ELSE 'VALID' END AS verdict
FROM m WHERE n_matched > 0
""")
def contamination_match(spark, sf_dir):
    """Which documents repeat sentences of the benchmark, with match rate and verdict."""
    parts = lambda name, *keep: table(spark, sf_dir, name).select(*keep, F.explode(F.filter(F.split("text", r"[.\n]+ ?"), lambda x: F.length(x) > 10)).alias("part"))
    refs = parts("benchmark").distinct().withColumn("hit", F.lit(True))
    counts = parts("documents", "doc_id").join(refs, "part", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parts"), F.count("hit").alias("n_matched")).where("n_matched > 0")
    return counts.withColumn("match_rate", F.bround(F.col("n_matched") / F.col("n_parts"), 6)).withColumn("verdict", matching.diff_health(F.col("n_matched"), F.col("n_parts"), F.col("n_parts")))


SENTENCES = "list_filter(list_transform(string_split(replace({0}, '. ', '.' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: length(x) > 30)"


@query(f"""
WITH b AS (SELECT item_id, unnest({SENTENCES.format('text')}) AS sentence FROM benchmark), d AS (SELECT DISTINCT unnest({SENTENCES.format('text')}) AS sentence FROM documents)
SELECT item_id, sentence FROM b ANTI JOIN d USING (sentence)
""")
def missing_sentences(spark, sf_dir):
    of = lambda name, *keep: table(spark, sf_dir, name).select(*keep, F.explode(t.sentences(F.col("text"))).alias("sentence"))
    return matching.missing(of("benchmark", "item_id"), of("documents"), ["sentence"]).select("item_id", "sentence")


@query()
def fuzzy_missing(spark, sf_dir):
    """Benchmark sentences without a near match among all document sentences."""
    of = lambda name, *keep: table(spark, sf_dir, name).select(*keep, F.explode(t.sentences(F.col("text"))).alias("sentence"))
    return matching.fuzzy_missing(of("benchmark", "item_id"), of("documents"), "sentence").select("item_id", "sentence")


#: Each character by itself, so that no order of replacements matters.
TEX = """array_to_string(list_transform(string_split({0}, ''), lambda c: CASE c WHEN '\\' THEN '\\textbackslash{{}}' WHEN '&' THEN '\\&' WHEN '%' THEN '\\%' WHEN '$' THEN '\\$' WHEN '#' THEN '\\#' WHEN '_' THEN '\\_' WHEN '{{' THEN '\\{{' WHEN '}}' THEN '\\}}'
  WHEN '~' THEN '\\textasciitilde{{}}' WHEN '^' THEN '\\textasciicircum{{}}' WHEN chr(8211) THEN '--' WHEN chr(8212) THEN '---' WHEN chr(8722) THEN '-' WHEN chr(160) THEN '~' WHEN chr(8195) THEN '\\quad ' WHEN chr(8194) THEN '\\enspace '
  WHEN chr(8226) THEN '\\ensuremath{{\\bullet}}' WHEN chr(8594) THEN '\\ensuremath{{\\rightarrow}}' WHEN chr(8592) THEN '\\ensuremath{{\\leftarrow}}' ELSE c END), '')"""


@query(f"SELECT doc_id, {TEX.format('text')} AS tex FROM documents")
def latex_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.latex_escape(F.col("text")).alias("tex"))


@query(r"""SELECT event_id, CASE WHEN value < 90 THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) || ' seconds' ELSE CAST(CAST(ceil(value / 60) AS BIGINT) AS VARCHAR) || ' minutes' END AS retry FROM events""")
def retry_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.retry_text(F.col("value")).alias("retry"))


@query(r"""SELECT p_partkey, nullif(translate(lower(trim(p_name)), '- ', '__'), '') AS label, CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '...' ELSE p_name END AS short FROM part""")
def label_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.normalise_label(F.col("p_name")).alias("label"), t.preview(F.col("p_name"), 8).alias("short"))


# --- matching


@query(r"""
WITH n AS (SELECT doc_id, source, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS norm FROM documents),
r AS (SELECT norm, doc_id, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS k FROM n WHERE doc_id % 2 = 0),
e AS (SELECT norm, doc_id, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS k FROM n WHERE doc_id % 2 = 1)
SELECT r.doc_id AS ref_doc_id, e.doc_id AS gen_doc_id, CAST(r.k AS INTEGER) AS k FROM r JOIN e ON r.norm = e.norm AND r.k = e.k
""")
def duplicate_pairing(spark, sf_dir):
    """The even documents against the odd ones: equal texts, the k-th with the k-th."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(t.collapse(F.col("text"), t.ASCII_SPACE).cast("binary")).alias("norm"))
    pairs = matching.kth_duplicates(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), [], "norm", ["doc_id"])
    return pairs.select("ref_doc_id", "gen_doc_id", "k")


TITLES = r"""(SELECT page_id, t.ord, trim(lower(regexp_replace(regexp_replace(t.title, '^[\d.]+\s*', ''), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', '', 'g'))) AS title FROM
  (SELECT page_id, unnest(range(0, len(h))) AS ord, unnest(h) AS title FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS h FROM pages)) t)"""


def _titles(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))).alias("ord", "title"))
    return rows.select("page_id", "ord", t.normalise_title(F.col("title")).alias("title"))


@query(f"SELECT page_id, CAST(ord AS INTEGER) AS ord, title FROM {TITLES}")
def page_outline(spark, sf_dir):
    return _titles(spark, sf_dir)


@query(f"""
WITH t AS (SELECT * FROM {TITLES}), r AS (SELECT DISTINCT title FROM t WHERE page_id % 2 = 0), e AS (SELECT DISTINCT title FROM t WHERE page_id % 2 = 1)
SELECT title, 'missing' AS kind FROM r ANTI JOIN e USING (title) UNION ALL SELECT title, 'extra' AS kind FROM e ANTI JOIN r USING (title)
""")
def outline_diff(spark, sf_dir):
    titles = _titles(spark, sf_dir)
    ref, gen = titles.where("page_id % 2 = 0").select("title").distinct(), titles.where("page_id % 2 = 1").select("title").distinct()
    return matching.missing(ref, gen, ["title"]).withColumn("kind", F.lit("missing")).unionAll(matching.missing(gen, ref, ["title"]).withColumn("kind", F.lit("extra")))


@query("""
WITH c AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS k, length(text) AS n FROM conversations),
u AS (SELECT conv_id, k, n FROM c WHERE role = 'user'), a AS (SELECT conv_id, k, n FROM c WHERE role = 'assistant')
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, CAST(coalesce(u.k, a.k) AS INTEGER) AS k, CAST(coalesce(u.n, 0) AS INTEGER) AS ref_value, CAST(coalesce(a.n, 0) AS INTEGER) AS gen_value, u.k IS NOT NULL AS in_ref, a.k IS NOT NULL AS in_gen
FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.k = a.k
""")
def page_alignment(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))).withColumn("n", F.length("text"))
    return matching.align(turns.where("role = 'user'"), turns.where("role = 'assistant'"), ["conv_id", "k"], "n", 0)


@query("""
WITH c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) THEN 0 ELSE 1 END AS fresh FROM conversations),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM r GROUP BY conv_id, run, role
""")
def role_runs(spark, sf_dir):
    runs = d.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text"], ["role"])
    return runs.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("n_chars"))


BOXES = """SELECT vec_id, label, vec_id // 10 AS page, CAST(vec_id % 10 AS INTEGER) AS ord, greatest(0, least(0.9, 0.5 + embedding[1]))::DOUBLE AS x0, greatest(0, least(0.9, 0.5 + embedding[2]))::DOUBLE AS y0,
  greatest(0, least(0.9, 0.5 + embedding[1]))::DOUBLE + 0.05 + abs(embedding[3])::DOUBLE AS x1, greatest(0, least(0.9, 0.5 + embedding[2]))::DOUBLE + 0.05 + abs(embedding[4])::DOUBLE AS y1 FROM embeddings"""


def _boxes(spark, sf_dir):
    """Boxes from the embeddings' first dimensions, ten to a page."""
    v = lambda k: F.col("embedding")[k].cast("double")
    low = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(0.9), F.lit(0.5) + v(k)))
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", F.expr("vec_id div 10").alias("page"), (F.col("vec_id") % 10).cast("int").alias("ord"), low(0).alias("x0"), low(1).alias("y0"), (low(0) + 0.05 + F.abs(v(2))).alias("x1"), (low(1) + 0.05 + F.abs(v(3))).alias("y1"))


BOXES = BOXES.replace("0.5 + embedding[1]", "0.5::DOUBLE + embedding[1]::DOUBLE").replace("0.5 + embedding[2]", "0.5::DOUBLE + embedding[2]::DOUBLE").replace("0.9", "0.9::DOUBLE").replace("+ 0.05 +", "+ 0.05::DOUBLE +").replace("abs(embedding[3])::DOUBLE", "abs(embedding[3]::DOUBLE)").replace("abs(embedding[4])::DOUBLE", "abs(embedding[4]::DOUBLE)")
IOU = "CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} / ((p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {w} * {h}) ELSE 0 END".replace("{w}", "(least(p.x1, t.x1) - greatest(p.x0, t.x0))").replace("{h}", "(least(p.y1, t.y1) - greatest(p.y0, t.y0))")


@query(f"""
WITH b AS ({BOXES}), t AS (SELECT page, ord, label % 3 AS label, x0, y0, x1, y1 FROM b WHERE ord < 5), p AS (SELECT page, ord, label % 3 AS label, x0, y0, x1, y1 FROM b WHERE ord >= 5),
m AS (SELECT p.page, p.ord, t.ord AS gt, {IOU} AS iou FROM p JOIN t ON p.page = t.page AND p.label = t.label),
x AS (SELECT page, ord, arg_max(gt, {{'iou': iou, 'g': -gt}}) AS gt FROM m WHERE iou >= 0.1 GROUP BY page, ord),
h AS (SELECT page, count(*) AS tp FROM (SELECT page, gt FROM x GROUP BY page, gt) GROUP BY page),
s AS (SELECT q.page, q.gt, coalesce(h.tp, 0) AS tp, coalesce(f.n, 0) AS n FROM (SELECT page, count(*) AS gt FROM t GROUP BY page) q LEFT JOIN h USING (page) LEFT JOIN (SELECT page, count(*) AS n FROM p GROUP BY page) f USING (page))
SELECT page, gt, tp, n - tp AS fp, gt - tp AS fn, round_even(CASE WHEN n > 0 THEN tp / n ELSE 0 END, 6) AS "precision", round_even(tp / gt, 6) AS recall FROM s
""")
def iou_match(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).withColumn("label", (F.col("label") % 3).cast("string"))
    truth, found = boxes.where("ord < 5"), boxes.where("ord >= 5")
    scores = matching.detection_scores(truth, matching.score_detections(truth, found, ["page"], least=0.1), ["page"])
    return scores.select("page", "gt", "tp", "fp", "fn", F.bround("precision", 6).alias("precision"), F.bround("recall", 6).alias("recall"))


@query(f"""
WITH b AS ({BOXES}), r AS (SELECT page, ord, CAST(label AS VARCHAR) AS label, x0, y0, x1, y1 FROM b WHERE ord < 5), q AS (SELECT vec_id, page, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM b WHERE ord >= 5)
SELECT q.vec_id, coalesce(arg_min(r.label, r.ord), 'unknown') AS label FROM q LEFT JOIN r ON q.page = r.page AND q.x BETWEEN r.x0 AND r.x1 AND q.y BETWEEN r.y0 AND r.y1 GROUP BY q.vec_id
""")
def region_of_point(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    x, y = g.box().centre
    points = boxes.where("ord >= 5").select("vec_id", "page", x.alias("x"), y.alias("y"))
    return matching.first_region(points, boxes.where("ord < 5").withColumn("label", F.col("label").cast("string")), ["page"]).select("vec_id", "label")


@query()
def greedy_match(spark, sf_dir):
    """Vision matching of boxes with texts: the generated side is shifted by a page for every fourth page."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = _boxes(spark, sf_dir).join(texts, "vec_id").withColumn("doc_id", F.expr("page div 4"))
    side = rows.select("doc_id", "page", F.col("vec_id").alias("ord"), "text", "x0", "y0", "x1", "y1")
    gen = side.withColumn("page", F.col("page") + (F.col("page") % 4 == 3).cast("int")).withColumn("x0", F.col("x0") * 0.98)
    # whole texts are compared, but only the scores go on to the matching
    found = matching.greedy(matching.vision_candidates(side, gen).select("doc_id", "ref_ord", "gen_ord", "score"))
    return found.select("doc_id", "ref_ord", "gen_ord", F.bround("score", 6).alias("score"))


@query(f"""
WITH b AS ({BOXES}), c AS (SELECT label, CAST(round(x0 * 1000) AS BIGINT) AS x, count(*) AS c FROM b GROUP BY 1, 2),
p AS (SELECT label, x, lead(x) OVER w AS nx, sum(c) OVER w AS nl, sum(x * c) OVER w AS sl, sum(c) OVER (PARTITION BY label) AS n, sum(x * c) OVER (PARTITION BY label) AS st FROM c WINDOW w AS (PARTITION BY label ORDER BY x ROWS UNBOUNDED PRECEDING)),
s AS (SELECT label, x, nx, CAST(nl AS BIGINT) AS nl, CAST(n AS BIGINT) AS n, CAST(sl AS DOUBLE) AS sl, CAST(st - sl AS DOUBLE) AS sr FROM p WHERE nx IS NOT NULL)
SELECT label, r.nl AS nl, r.n AS n, r.x AS left_max, r.nx AS right_min, round_even((r.sl / r.nl + r.sr / (r.n - r.nl)) / 2, 6) AS boundary FROM (
  SELECT label, arg_max({{'nl': nl, 'n': n, 'x': x, 'nx': nx, 'sl': sl, 'sr': sr}}, {{'b': sl * sl / nl + sr * sr / (n - nl), 'o': -nl}}) AS r FROM s GROUP BY label)
""")
def column_split(spark, sf_dir):
    points = _boxes(spark, sf_dir).select("label", F.round(F.col("x0") * 1000).cast("long").alias("x"))
    found = layout.two_means(points.withColumn("x", F.col("x")), ["label"])
    return found.select("label", "nl", "n", "left_max", "right_min", F.bround("boundary", 6).alias("boundary"))


@query("""
WITH s AS (SELECT event_type, greatest(0::DOUBLE, 1 - value / 500) AS x0, event_id % 5 + 1 AS w FROM events), t AS (SELECT event_type, x0, least(1::DOUBLE, x0 + w / 60::DOUBLE) AS x1 FROM s),
c AS (SELECT event_type, CAST(least(59, floor(x0 * 60)) AS INTEGER) AS b0, CAST(least(59, ceil(x1 * 60)) AS INTEGER) AS b1 FROM t),
e AS (SELECT event_type, unnest(range(b0, b1)) AS bin FROM c), k AS (SELECT event_type, bin, count(*) AS n FROM e GROUP BY 1, 2),
a AS (SELECT f.event_type, b.bin, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT event_type FROM s) f CROSS JOIN (SELECT unnest(range(0, 60)) AS bin) b LEFT JOIN k ON k.event_type = f.event_type AND k.bin = b.bin),
m AS (SELECT *, floor(0.25 * max(n) OVER (PARTITION BY event_type)) AS lim FROM a), i AS (SELECT *, n <= lim AS low FROM m WHERE bin BETWEEN 6 AND 53),
r AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM i)
SELECT event_type, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n_bins FROM r WHERE low GROUP BY event_type, run HAVING max(bin) < 53
""")
def coverage_gap(spark, sf_dir):
    """Runs of bins that few events cover; all events, the larger values further left."""
    x0 = F.greatest(F.lit(0.0), 1 - F.col("value") / 500)
    spans = table(spark, sf_dir, "events").select("event_type", x0.alias("x0"), F.least(F.lit(1.0), x0 + (F.col("event_id") % 5 + 1) / 60).alias("x1"))
    return layout.low_coverage_runs(spans, ["event_type"], bins=60).select("event_type", F.col("first_bin").cast("long"), F.col("last_bin").cast("long"), "n_bins")


# --- statistics, gates, policies


@query("""
WITH s AS (SELECT l_returnflag, l_quantity AS size, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, arg_max(size, {'w': w, 's': size}) AS mode, CAST(max(w) AS BIGINT) AS weight FROM s GROUP BY 1
""")
def weighted_mode(spark, sf_dir):
    return layout.weighted_mode(table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("mode"), "l_extendedprice"), ["l_returnflag"], "mode", F.floor("l_extendedprice").cast("long"))


@query("""
WITH c AS (SELECT l_linestatus, l_shipdate, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2)
SELECT l_linestatus, CAST(CAST(arg_max(l_shipdate, {'n': n, 'f': -first, 'd': l_shipdate}) AS DATE) AS VARCHAR) AS mode, max(n) AS n FROM c GROUP BY 1
""")
def first_seen_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_shipdate").cast("date").cast("string").alias("day"), "l_orderkey")
    return layout.first_seen_mode(rows, ["l_linestatus"], "day", "l_orderkey").select("l_linestatus", "mode", "n")


_Q = "quantile_cont({0}, 0.25) AS p25_{0}, quantile_cont({0}, 0.5) AS median_{0}, quantile_cont({0}, 0.75) AS p75_{0}"


@query(f"""
WITH x AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity - 25 AS DOUBLE) AS dx, CAST(l_linenumber * l_linenumber * l_linenumber - 60 AS DOUBLE) AS dy FROM lineitem),
s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, {_Q.format('dx')}, {_Q.format('dy')} FROM x GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, any_value(n) AS n, any_value(median_dx) AS median_dx, any_value(p75_dx - p25_dx) AS iqr_dx, any_value(median_dy) AS median_dy, any_value(p75_dy - p25_dy) AS iqr_dy,
  count(*) FILTER (WHERE abs(dx - median_dx) > 0.9::DOUBLE * (p75_dx - p25_dx)) AS outliers_dx, count(*) FILTER (WHERE NOT abs(dx - median_dx) > 0.9::DOUBLE * (p75_dx - p25_dx) AND abs(dy - median_dy) > 0.9::DOUBLE * (p75_dy - p25_dy)) AS outliers_dy
FROM x JOIN s USING (l_returnflag, l_linestatus) GROUP BY 1, 2
""")
def drift_stats(spark, sf_dir):
    by = ["l_returnflag", "l_linestatus"]
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(*by, (F.col("l_quantity") - 25).cast("double").alias("dx"), (line * line * line - 60).cast("double").alias("dy"))
    stats = drift.with_outliers(rows, by, ("dx", "dy"), drift.quartiles(rows, by, ["dx", "dy"]), times=0.9)
    return stats.select(*by, "n", "median_dx", "iqr_dx", "median_dy", "iqr_dy", "outliers_dx", "outliers_dy")


STATUS = "CASE WHEN event_id % 13 = 0 THEN 'MISSING_PAGE' WHEN value < 5 THEN 'TINY' WHEN value > 150 THEN 'BLANK' ELSE 'SCORED' END"
SUMMARY = f"""SELECT event_type, count(*) AS total, count(*) FILTER (WHERE status = 'SCORED') AS count_scored, count(*) FILTER (WHERE status = 'MISSING_PAGE') AS missing, count(*) FILTER (WHERE status = 'TINY') AS tiny, count(*) FILTER (WHERE status = 'BLANK') AS blank,
  round_even(quantile_cont(CASE WHEN status = 'SCORED' THEN value END, 0.5), 6) AS p50, round_even(quantile_cont(CASE WHEN status = 'SCORED' THEN value END, 0.1), 6) AS p10, min(CASE WHEN status = 'SCORED' THEN value END) AS "min"
  FROM (SELECT event_type, value, {STATUS} AS status FROM events) GROUP BY event_type"""


def _regions(spark, sf_dir):
    """Events as scored regions."""
    rows = table(spark, sf_dir, "events")
    status = drift.region_status(F.lit(True), F.col("event_id") % 13 != 0, F.lit(True), F.col("value") < 5, F.col("value") > 150)
    return rows.select("event_id", "user_id", "event_type", F.col("value").alias("score"), status.alias("status"))


@query(f"SELECT *, round_even(count_scored / total, 6) AS coverage_strict, round_even(count_scored / (total - tiny - blank), 6) AS coverage_effective FROM ({SUMMARY})")
def label_summary(spark, sf_dir):
    s = drift.label_summary(_regions(spark, sf_dir), ["event_type"])
    r = lambda c: F.bround(c, 6).alias(c)
    return s.select("event_type", "total", "count_scored", "missing", "tiny", "blank", r("p50"), r("p10"), "min", r("coverage_strict"), r("coverage_effective"))


GATES = [("title", "coverage_min_effective", 0.93), ("title", "missing_page_max", 60.0), ("click", "min_regions", 1000000.0), ("view", "coverage_min_effective", 0.5), ("view", "missing_page_max", 1e9), ("error", "missing_page_max", 0.0)]
OWN_GATES = [("3", "error", "missing_page_max", 1e9), ("3", "error", "coverage_min_effective", 0.1), ("5", "view", "coverage_min_effective", 1.0)]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in r) + ")" for r in rows)


@query(f"""
WITH s AS (SELECT CAST(user_id % 7 AS VARCHAR) AS doc_id, event_type AS label, count(*) FILTER (WHERE status = 'SCORED') AS count_scored, count(*) FILTER (WHERE status = 'MISSING_PAGE') AS missing_page,
    count(*) FILTER (WHERE status = 'SCORED') / count(*) FILTER (WHERE status NOT IN ('TINY', 'BLANK')) AS coverage FROM (SELECT user_id, event_type, {STATUS} AS status FROM events) GROUP BY 1, 2),
d(label, param, value) AS (VALUES {_values(GATES)}), o(doc_id, label, param, value) AS (VALUES {_values(OWN_GATES)}),
k AS (SELECT doc_id, s.label, CASE WHEN s.label IN (SELECT label FROM d) THEN s.label ELSE 'title' END AS from_label FROM s),
p(param) AS (VALUES ('min_regions'), ('missing_page_max'), ('coverage_min_effective')),
v AS (SELECT k.doc_id, k.label, p.param, coalesce(o.value, d.value, CASE p.param WHEN 'min_regions' THEN 1 WHEN 'missing_page_max' THEN 0 ELSE 0.7 END) AS value
  FROM k CROSS JOIN p LEFT JOIN o ON o.doc_id = k.doc_id AND o.label = k.label AND o.param = p.param LEFT JOIN d ON d.label = k.from_label AND d.param = p.param),
w AS (SELECT doc_id, label, max(value) FILTER (WHERE param = 'min_regions') AS mr, max(value) FILTER (WHERE param = 'missing_page_max') AS mp, max(value) FILTER (WHERE param = 'coverage_min_effective') AS ce FROM v GROUP BY 1, 2)
SELECT doc_id, label, CASE WHEN count_scored < mr THEN 'SKIP' WHEN missing_page > mp OR coverage < ce THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN count_scored < mr THEN 'regions' ELSE concat_ws(',', CASE WHEN missing_page > mp THEN 'missing_page' END, CASE WHEN coverage < ce THEN 'coverage' END) END AS violations
FROM s JOIN w USING (doc_id, label)
""")
def gate_eval(spark, sf_dir):
    regions = _regions(spark, sf_dir).withColumn("doc_id", (F.col("user_id") % 7).cast("string")).withColumn("label", F.col("event_type"))
    s = drift.label_summary(regions, ["doc_id", "label"])
    none = F.lit(0).cast("long")
    stats = s.select("doc_id", "label", "count_scored", none.alias("hit_boundary"), none.alias("blank_gen"), F.col("missing").alias("missing_page"), F.lit(None).cast("double").alias("median_dx"), F.lit(None).cast("double").alias("median_dy"), F.col("coverage_effective").alias("coverage"))
    defaults = spark.createDataFrame(GATES, "label string, param string, value double")
    own = spark.createDataFrame(OWN_GATES, "doc_id string, label string, param string, value double")
    found = drift.gate_labels(stats, drift.overlay(defaults, own, stats.select("doc_id", "label")))
    return found.select("doc_id", "label", "status", F.array_join("violations", ",").alias("violations"))


@query("SELECT event_id, event_type, value AS score FROM events ORDER BY value, event_id LIMIT 20")
def worst_k(spark, sf_dir):
    return drift.worst(_regions(spark, sf_dir), ["event_id"]).select("event_id", "event_type", "score")


@query("""
WITH x AS (SELECT quality, CASE WHEN length(text) > 300 AND NOT contains(text, '%%%') AND NOT contains(text, '!!') THEN 1 ELSE 0 END AS said FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE said = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE said = 1 AND quality = 0) AS fp, count(*) FILTER (WHERE said = 0 AND quality = 1) AS fn FROM x)
SELECT tp, fp, fn, round_even(tp / (tp + fp), 6) AS "precision", round_even(tp / (tp + fn), 6) AS recall, round_even(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
""")
def confusion(spark, sf_dir):
    """A rule of thumb for quality against the labels."""
    said = (F.length("text") > 300) & ~F.contains("text", F.lit("%%%")) & ~F.contains("text", F.lit("!!"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("said")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    good = F.col("quality") == 1
    c = rows.agg(F.count_if(F.col("said") & good).alias("tp"), F.count_if(F.col("said") & ~good).alias("fp"), F.count_if(~F.col("said") & good).alias("fn"))
    found = matching.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("tp", "fp", "fn", *[F.bround(x, 6).alias(n) for x, n in zip(found, ("precision", "recall", "f1"), strict=True)])


@query("""
WITH c AS (SELECT l_partkey, count(*) FILTER (WHERE l_quantity > 40) AS merged, count(*) FILTER (WHERE l_linenumber = 1) AS first, count(DISTINCT l_linenumber) AS n_rows FROM lineitem GROUP BY 1),
s AS (SELECT l_partkey, 2 * merged + CASE WHEN first > 4 THEN 3 ELSE 0 END + CASE WHEN n_rows > 6 THEN 3 ELSE 0 END AS complexity FROM c)
SELECT l_partkey, complexity, CASE WHEN complexity > 18 THEN 'fallback' ELSE 'semantic' END AS decision, CASE WHEN complexity > 18 THEN 'OOXML_COMPLEXITY_HIGH_' || CAST(complexity AS VARCHAR) ELSE 'OOXML_TRUTHS_TABLE' END AS reason FROM s
""")
def complexity_policy(spark, sf_dir):
    """Parts as tables: their line items are cells, those of more than 40 pieces are merged."""
    cells = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_linenumber") - 1).alias("row_idx"), F.when(F.col("l_quantity") > 40, 2).otherwise(1).alias("col_span"), F.lit(1).alias("row_span"))
    decision, reason = d.table_policy(F.col("complexity"))
    return d.table_complexity(cells, ["l_partkey"], wide=4, long=6).select("l_partkey", "complexity", decision.alias("decision"), reason.alias("reason"))


@query("""
SELECT s_suppkey, round_even(CASE WHEN i > 1.05 THEN greatest(0.6, least(1.0, 1.0 / pow(i, 0.7))) WHEN i < 0.95 THEN least(1.2, 1.0 / pow(i, 0.5)) ELSE 1.0 END, 6) AS squeeze,
  round_even(CASE WHEN i > 1.05 THEN greatest(0.7, 1.15 / pow(i, 0.7)) ELSE 1.15 END, 6) AS line_spacing FROM (SELECT s_suppkey, (s_acctbal + 2000) / 6000 AS i FROM supplier)
""")
def correction_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_acctbal") + 2000) / 6000).alias("i"))
    squeeze, spacing = drift.corrected_spacing(F.col("i"), F.lit(1.0), F.lit(1.15))
    return rows.select("s_suppkey", F.bround(squeeze, 6).alias("squeeze"), F.bround(spacing, 6).alias("line_spacing"))


@query("""
WITH m AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS epoch, o_orderstatus, count(*) AS metric FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, max(metric) AS best, arg_max(epoch, {'m': metric, 'e': -epoch}) AS epoch FROM m GROUP BY 1
""")
def best_epoch(spark, sf_dir):
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("epoch")
    metric = table(spark, sf_dir, "orders").groupBy(month, "o_orderstatus").agg(F.count(F.lit(1)).alias("metric"))
    found = scans.best_epochs(metric, ["o_orderstatus"], "epoch", ["metric"])
    return found.select("o_orderstatus", F.col("best").cast("long").alias("best"), "epoch")


@query("""
WITH s AS (SELECT user_id, date_trunc('hour', ts) AS h FROM events), q AS (SELECT DISTINCT user_id, CAST(epoch(h) AS BIGINT) // 3600 AS h FROM s),
g AS (SELECT user_id, h - lag(h) OVER (PARTITION BY user_id ORDER BY h) AS gap FROM q), k AS (SELECT user_id, gap, count(*) AS n FROM g WHERE gap BETWEEN 2 AND 40 GROUP BY 1, 2)
SELECT user_id, arg_max(gap, {'n': n, 'g': -gap}) AS spacing, max(n) AS n FROM k GROUP BY 1
""")
def adjacent_gap_mode(spark, sf_dir):
    hour = F.floor(F.unix_timestamp("ts") / 3600).alias("h")
    found = layout.spacing_mode(table(spark, sf_dir, "events").select("user_id", hour), ["user_id"], "h", 2, 40, 1)
    return found.select("user_id", F.col("spacing").cast("long").alias("spacing"), "n")


@query("""
SELECT p_type, CASE WHEN r < 1.05 THEN 1.0 WHEN r < 1.25 THEN 1.15 WHEN r < 1.4 THEN 1.25 WHEN r < 1.6 THEN 1.5 WHEN r < 2.2 THEN 2.0 ELSE r END::DOUBLE AS spacing, count(*) AS n
FROM (SELECT p_type, p_size / 20::DOUBLE AS r FROM part) GROUP BY 1, 2
""")
def spacing_buckets(spark, sf_dir):
    spacing = g.line_spacing_bucket(F.col("p_size") / 20.0)
    return table(spark, sf_dir, "part").groupBy("p_type", spacing.alias("spacing")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH b AS (SELECT o_custkey, o_orderkey, ['heading', 'paragraph', 'list', 'table', 'layout_grid', 'figure', 'textbox'][o_orderkey % 7 + 1] AS kind, o_orderkey % 25 AS score FROM orders),
p AS (SELECT *, CASE WHEN kind = 'table' AND score > 18 THEN 'fallback' ELSE 'semantic' END AS policy FROM b),
s AS (SELECT o_custkey, count(*) FILTER (WHERE l_quantity > 40) AS n_bold, count(*) FILTER (WHERE l_discount > 0.05) AS n_italic, count(*) FILTER (WHERE l_tax > 0.05) AS n_underline FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT p.o_custkey, count(*) FILTER (WHERE kind = 'heading') AS n_heading, count(*) FILTER (WHERE kind = 'table') AS n_table, CAST(sum(CASE WHEN kind = 'list' THEN o_orderkey % 4 ELSE 0 END) AS BIGINT) AS n_list_items,
  count(*) FILTER (WHERE kind = 'table' AND score <= 8) AS tables_simple, count(*) FILTER (WHERE kind = 'table' AND score BETWEEN 9 AND 18) AS tables_medium, count(*) FILTER (WHERE kind = 'table' AND score > 18) AS tables_complex,
  count(*) FILTER (WHERE policy = 'fallback') AS n_fallback, count(*) FILTER (WHERE policy = 'semantic') AS n_semantic, coalesce(string_agg('b' || CAST(o_orderkey AS VARCHAR), ',' ORDER BY 'b' || CAST(o_orderkey AS VARCHAR)) FILTER (WHERE policy = 'fallback'), '') AS fallbacks,
  coalesce(any_value(n_bold), 0) AS n_bold, coalesce(any_value(n_italic), 0) AS n_italic, coalesce(any_value(n_underline), 0) AS n_underline
FROM p LEFT JOIN s ON s.o_custkey = p.o_custkey GROUP BY p.o_custkey
""")
def conversion_report(spark, sf_dir):
    """Customers as documents, their orders as blocks and the line items as spans."""
    key, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    kinds = F.array(*[F.lit(k) for k in ("heading", "paragraph", "list", "table", "layout_grid", "figure", "textbox")])
    blocks = orders.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("b"), key.cast("string")).alias("block_id"), kinds[(key % 7).cast("int")].alias("block_type"), (key % 25).alias("complexity_score"), (key % 4).alias("items"))
    blocks = blocks.withColumn("n_items", F.when(F.col("block_type") == "list", F.col("items"))).withColumn("policy", F.when(F.col("block_type") == "table", d.table_policy(F.col("complexity_score"))[0]).otherwise("semantic"))
    spans = table(spark, sf_dir, "lineitem").join(orders.select(key.alias("l_orderkey"), F.col("o_custkey").alias("doc_id")), "l_orderkey").select("doc_id", (F.col("l_quantity") > 40).alias("bold"), (F.col("l_discount") > 0.05).alias("italic"), (F.col("l_tax") > 0.05).alias("underline"))
    names = ("n_heading", "n_table", "n_list_items", "tables_simple", "tables_medium", "tables_complex", "n_fallback", "n_semantic", "n_bold", "n_italic", "n_underline")
    return d.conversion_report(blocks, spans).select(F.col("doc_id").alias("o_custkey"), *names, F.array_join("fallbacks", ",").alias("fallbacks"))


@query("""
WITH x AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most, count(*) FILTER (WHERE k > 50) AS n_large FROM x GROUP BY event_type
""")
def json_extract(spark, sf_dir):
    """The object in an answer's text, which has braces before and behind it."""
    answer = F.concat(F.lit("Well, {as asked}: "), F.col("props"), F.lit(" and {no more"))
    k = F.from_json(labels.first_json(answer), "k long")["k"]
    rows = table(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"), F.count_if(F.col("k") > 50).alias("n_large"))


@query("""
WITH p AS (SELECT conv_id, turn, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, left(string_agg(text, chr(10) ORDER BY turn, text), 600) AS text, count(*) AS n_parts FROM p WHERE before < 600 GROUP BY conv_id
""")
def capped_text(spark, sf_dir):
    return d.capped_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 600)


@query("SELECT doc_id, CASE WHEN CAST('0x' || left(md5('0:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents")
def seeded_split(spark, sf_dir):
    return d.split_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"""
WITH b AS ({BOXES}), c AS (SELECT vec_id, label, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, y1 - y0 AS h FROM b)
SELECT vec_id, CAST(label AS VARCHAR) || ' ' || printf('%.6f', least(1, greatest(0, cx))) || ' ' || printf('%.6f', least(1, greatest(0, cy))) || ' ' || printf('%.6f', least(1, greatest(0.001, w))) || ' ' || printf('%.6f', least(1, greatest(0.001, h))) AS line
FROM c WHERE label <> 7 AND NOT (cx + w / 2 <= 0 OR cx - w / 2 >= 1 OR cy + h / 2 <= 0 OR cy - h / 2 >= 1)
""")
def label_convert(spark, sf_dir):
    """Boxes to label lines; label 7 has no class and is dropped."""
    classes = spark.createDataFrame([(k, k) for k in range(10) if k != 7], "label int, class_id int")
    rows = _boxes(spark, sf_dir).join(classes, "label")
    return rows.select("vec_id", g.yolo_line(F.col("class_id"), *g.box_to_centre(g.box())).alias("line")).where("line is not null")


@query("""
WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey // 3 END AS up, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS v FROM customer),
w AS (SELECT id, up, v, 0 AS depth FROM n UNION ALL SELECT w.id, n.up, n.v, depth + 1 FROM w JOIN n ON w.up = n.id WHERE w.v IS NULL AND depth < 1000)
SELECT id AS style_id, max(v) AS v FROM w GROUP BY id
""")
def style_inherit(spark, sf_dir):
    """Customers as styles: each is based on the one with a third of its number."""
    key = F.col("c_custkey")
    styles = table(spark, sf_dir, "customer").select(F.lit(1).alias("doc_id"), key.alias("style_id"), F.when(key % 7 != 0, F.expr("c_custkey div 3")).alias("based_on"), F.when(key % 5 == 0, F.col("c_mktsegment")).alias("v"))
    return d.inherited(styles, "v").select("style_id", "v")


# --- state


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, ts, k, true AS accepted, ts AS last FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.ts, e.k, e.ts >= w.last + INTERVAL 24 HOUR, CASE WHEN e.ts >= w.last + INTERVAL 24 HOUR THEN e.ts ELSE w.last END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, count(*) AS n_accepted, CAST(sum(event_id) AS BIGINT) AS id_sum FROM w WHERE accepted GROUP BY user_id
""")
def cooldown_hits(spark, sf_dir):
    """Events that a cooldown of a day per user lets pass."""
    found = cooldown.accepted(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 24 * 3600)
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_accepted"), F.sum("event_id").alias("id_sum"))


@query("SELECT event_type, count(DISTINCT user_id) AS visitors, count(*) AS conversions FROM events GROUP BY event_type")
def usage(spark, sf_dir):
    return cooldown.usage(table(spark, sf_dir, "events"))


from pagewright.plans import extended, structures, survey  # noqa: E402  register the rest

__all__ = ["ORACLE_SQL", "QUERIES", "extended", "structures", "survey"]
