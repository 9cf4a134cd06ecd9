"""Queries on tables with merged cells, text in detected boxes, nested blocks, exact splits and running ids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import augment, compare
from pagewright.operators import boxes, grid, nested, ranks, tabs
from pagewright.plans.catalogue import BOXES, _boxes
from pagewright.plans.registry import query, table
from pagewright.shared import dealt
from pagewright.streaming import cooldown

#: Line items of a part as a table: three to a row, cells of one column or two, of which many go on with the cell above.
CELLS = """SELECT l_partkey, CAST((k - 1) // 3 AS INTEGER) AS row_idx, CAST((k - 1) % 3 AS INTEGER) AS cell_idx, CASE WHEN l_quantity > 40 THEN 2 ELSE 1 END AS col_span, l_linenumber <> 3 AS v_merge, l_returnflag = 'R' AS v_restart,
  CASE WHEN l_tax > 0.02 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS text, k FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem)"""


def _cells(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")) - 1
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_partkey").withColumn("k", k)
    text = F.when(F.col("l_tax") > 0.02, F.col("l_orderkey").cast("string")).otherwise("")
    return rows.select("l_partkey", F.expr("k div 3").cast("int").alias("row_idx"), (F.col("k") % 3).alias("cell_idx"), F.when(F.col("l_quantity") > 40, 2).otherwise(1).alias("col_span"), (F.col("l_linenumber") != 3).alias("v_merge"), (F.col("l_returnflag") == "R").alias("v_restart"), text.alias("text"))


#: Rectangles by following each first cell downwards, cell by cell.
RECTANGLES = f"""
c AS ({CELLS}), p AS (SELECT *, coalesce(sum(col_span) OVER (PARTITION BY l_partkey, row_idx ORDER BY cell_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grid_col FROM c),
l AS (SELECT d.l_partkey, d.grid_col, d.row_idx FROM p d JOIN p u ON u.l_partkey = d.l_partkey AND u.grid_col = d.grid_col AND u.row_idx = d.row_idx - 1 AND u.col_span = d.col_span AND u.v_merge WHERE d.v_merge AND NOT d.v_restart),
r AS (
  SELECT p.l_partkey, p.grid_col, p.row_idx AS top, p.row_idx, p.cell_idx, p.col_span, p.text FROM p ANTI JOIN l ON l.l_partkey = p.l_partkey AND l.grid_col = p.grid_col AND l.row_idx = p.row_idx
  UNION ALL
  SELECT r.l_partkey, r.grid_col, r.top, l.row_idx, r.cell_idx, r.col_span, p.text FROM r JOIN l ON l.l_partkey = r.l_partkey AND l.grid_col = r.grid_col AND l.row_idx = r.row_idx + 1 JOIN p ON p.l_partkey = l.l_partkey AND p.grid_col = l.grid_col AND p.row_idx = l.row_idx
),
x AS (SELECT l_partkey, top AS row_idx, CAST(grid_col AS INTEGER) AS grid_col, min(cell_idx) AS cell_idx, min(col_span) AS col_span, CAST(count(*) AS INTEGER) AS row_span, coalesce(string_agg(text, chr(10) ORDER BY row_idx) FILTER (WHERE text <> ''), '') AS text FROM r GROUP BY ALL)
"""


@query(f"WITH RECURSIVE {RECTANGLES} SELECT *, CASE WHEN grid_col < 4 THEN CAST((CASE WHEN grid_col = 0 THEN 100 ELSE 0 END) + 50 * (least(4, grid_col + col_span) - greatest(1, grid_col)) AS DOUBLE) END AS width FROM x")
def grid_rectangles(spark, sf_dir):
    """The grid's columns are 100, 50, 50 and 50 wide."""
    found = grid.rectangles(grid.placed(_cells(spark, sf_dir), ["l_partkey"]), ["l_partkey"])
    return grid.sized(found, F.array(*[F.lit(w) for w in (100, 50, 50, 50)]))


@query(f"""
WITH RECURSIVE {RECTANGLES}, y AS (SELECT l_partkey, row_idx + i AS a, grid_col + j AS b FROM (SELECT *, unnest(range(col_span)) AS j FROM (SELECT *, unnest(range(row_span)) AS i FROM x))),
n AS (SELECT l_partkey, a, b, count(*) AS n FROM y GROUP BY ALL)
SELECT l_partkey, CAST(max(a) + 1 AS INTEGER) AS n_rows, CAST(max(b) + 1 AS INTEGER) AS n_columns, count(*) AS n_places, count(*) FILTER (WHERE n > 1) AS n_twice, CAST((max(a) + 1) * (max(b) + 1) AS BIGINT) - count(*) AS n_open FROM n GROUP BY l_partkey
""")
def grid_problems(spark, sf_dir):
    found = grid.rectangles(grid.placed(_cells(spark, sf_dir), ["l_partkey"]), ["l_partkey"])
    t = grid.problems(found, ["l_partkey"])
    return t.select("l_partkey", F.col("n_rows").cast("int").alias("n_rows"), F.col("n_columns").cast("int").alias("n_columns"), "n_places", "n_twice", "n_open")


@query(f"""
WITH b AS ({BOXES}), r AS (SELECT * FROM b WHERE ord < 4), w AS (SELECT *, CASE WHEN label = 2 THEN ' ' ELSE 'w' || CAST(label AS VARCHAR) END AS text FROM b WHERE ord >= 4),
m AS (SELECT r.vec_id AS region_id, w.vec_id AS word_id, w.text, round_even(w.y0, 1) AS line, w.x0, greatest(0, least(r.x1, w.x1) - greatest(r.x0, w.x0)) * greatest(0, least(r.y1, w.y1) - greatest(r.y0, w.y0)) / ((w.x1 - w.x0) * (w.y1 - w.y0)) AS share FROM r JOIN w ON r.page = w.page WHERE trim(w.text) <> ''),
l AS (SELECT region_id, line, string_agg(text, ' ' ORDER BY x0, word_id) AS text, count(*) AS n FROM m WHERE share > 0.3 GROUP BY ALL)
SELECT region_id AS vec_id, string_agg(text, chr(10) ORDER BY line) AS text, CAST(sum(n) AS BIGINT) AS n_words FROM l GROUP BY ALL
""")
def box_texts(spark, sf_dir):
    """Four boxes of a page as detected regions, the others as words."""
    rows = _boxes(spark, sf_dir)
    words = rows.where("ord >= 4").withColumn("text", F.when(F.col("label") == 2, " ").otherwise(F.concat(F.lit("w"), F.col("label").cast("string"))))
    return boxes.clipped_text(rows.where("ord < 4"), words, ["page"], "vec_id", "vec_id", 0.3).select("vec_id", "text", "n_words")


#: Events of a user as blocks inside each other; of every fifth user the first block is inside the fourth.
BLOCKS = """SELECT user_id AS doc_id, k AS ord, CASE WHEN user_id % 5 = 0 AND k = 1 THEN 4 WHEN k - 1 - event_id % 4 > 0 THEN k - 1 - event_id % 4 WHEN event_id % 7 = 3 THEN -1 END AS parent,
  CASE event_id % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'list' WHEN 2 THEN 'textbox' ELSE 'paragraph' END AS kind, CASE event_id % 9 WHEN 7 THEN 'header' WHEN 8 THEN 'footer' ELSE 'body' END AS scope,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS text, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"""
#: Each block's way up, level by level; the least block of a circle is cut off. Then the ways down.
WALKED = f"""
b AS ({BLOCKS}), q AS (SELECT b.* REPLACE (p.ord AS parent) FROM b LEFT JOIN b p ON p.doc_id = b.doc_id AND p.ord = b.parent),
u AS (SELECT doc_id, ord, parent AS up, [ord] AS seen FROM q UNION ALL SELECT u.doc_id, u.ord, q.parent, list_append(u.seen, q.ord) FROM u JOIN q ON q.doc_id = u.doc_id AND q.ord = u.up WHERE NOT list_contains(u.seen, u.up)),
z AS (SELECT DISTINCT doc_id, ord FROM u WHERE up = ord AND ord = list_min(seen)),
t AS (SELECT q.* REPLACE (CASE WHEN z.ord IS NULL THEN q.parent END AS parent) FROM q LEFT JOIN z ON z.doc_id = q.doc_id AND z.ord = q.ord),
w AS (SELECT *, [ord] AS path, -1::BIGINT AS inner_table, 0::BIGINT AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.*, list_append(w.path, t.ord), CASE WHEN w.kind = 'table' THEN w.depth ELSE w.inner_table END, w.depth + 1 FROM w JOIN t ON t.doc_id = w.doc_id AND t.parent = w.ord)
"""


def _blocks(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows, e = table(spark, sf_dir, "events").withColumn("k", k), F.col("event_id")
    up = F.col("k") - 1 - e % 4
    parent = F.when((F.col("user_id") % 5 == 0) & (F.col("k") == 1), F.lit(4).cast("long")).when(up > 0, up).when(e % 7 == 3, F.lit(-1).cast("long"))
    kind = F.when(e % 6 == 0, "table").when(e % 6 == 1, "list").when(e % 6 == 2, "textbox").otherwise("paragraph")
    scope = F.when(e % 9 == 7, "header").when(e % 9 == 8, "footer").otherwise("body")
    blocks = rows.select(F.col("user_id").alias("doc_id"), F.col("k").alias("ord"), parent.alias("parent"), kind.alias("kind"), scope.alias("scope"), "event_id")
    spans = blocks.where(e % 5 != 0).select("doc_id", F.col("ord").alias("block"), F.lit(1).alias("ord"), F.concat(F.lit(" "), e.cast("string"), F.lit("\n")).alias("text"))
    return blocks, spans


@query(f"""
WITH RECURSIVE {WALKED}, s AS (SELECT doc_id, path, inner_table, CASE WHEN kind = 'table' THEN 'TABLE' ELSE text END AS text, unnest(path) AS holder, unnest(range(len(path))) AS place FROM w),
x AS (SELECT doc_id, holder AS ord, string_agg(text, ' ' ORDER BY path) AS text FROM s WHERE text <> '' AND place > inner_table GROUP BY ALL)
SELECT w.doc_id, w.ord, coalesce(x.text, '') AS text, CAST(w.depth AS INTEGER) AS depth FROM w LEFT JOIN x USING (doc_id, ord) WHERE w.kind IN ('list', 'textbox', 'table')
""")
def nested_texts(spark, sf_dir):
    """Texts of lists, text boxes and tables, with all that is in them."""
    blocks, spans = _blocks(spark, sf_dir)
    return nested.nested_texts(nested.walk(blocks), nested.block_texts(blocks, spans), ("list", "textbox", "table")).select("doc_id", "ord", "text", "depth")


@query(f"""
WITH RECURSIVE {WALKED}, s AS (SELECT *, unnest(path) AS holder FROM w WHERE text <> '' AND scope = 'header'), x AS (SELECT doc_id, holder AS ord, string_agg(text, ' ' ORDER BY path) AS text FROM s GROUP BY ALL)
SELECT w.doc_id, 'header ' || CAST(w.ord AS VARCHAR) AS part, coalesce(x.text, '') AS text FROM w LEFT JOIN x USING (doc_id, ord) WHERE w.scope = 'header' AND w.kind = 'list'
UNION ALL SELECT doc_id, 'lines', string_agg(text, chr(10) ORDER BY path) FROM w WHERE depth = 0 AND text <> '' GROUP BY doc_id
""")
def scope_texts(spark, sf_dir):
    """Lists of headers, tables in them read like other blocks, and a line for each block at the top."""
    blocks, spans = _blocks(spark, sf_dir)
    walked, texts = nested.walk(blocks), nested.block_texts(blocks, spans)
    headers = nested.nested_texts(walked, texts, ("list",), table=None, scope=F.col("scope") == "header")
    headers = headers.select("doc_id", F.concat(F.lit("header "), F.col("ord").cast("string")).alias("part"), "text")
    return headers.unionByName(nested.document_text(walked, texts).select("doc_id", F.lit("lines").alias("part"), "text"))


@query(f"""
WITH RECURSIVE {WALKED}, f AS (SELECT w.* FROM w WHERE event_id % 2 = 0 AND scope <> 'footer' AND NOT EXISTS (SELECT 1 FROM w x WHERE x.doc_id = w.doc_id AND x.kind = 'textbox' AND list_contains(w.path, x.ord)))
SELECT doc_id, event_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN scope = 'header' THEN 1 ELSE 0 END, path, event_id) AS INTEGER) AS place FROM f
""")
def floating_order(spark, sf_dir):
    """A figure in each block; the even ones float."""
    blocks, _ = _blocks(spark, sf_dir)
    figures = blocks.select("doc_id", F.col("event_id").alias("ord"), F.col("ord").alias("block"), (F.col("event_id") % 2 == 0).alias("floating"))
    return nested.floating(nested.walk(blocks), figures).select("doc_id", F.col("ord").alias("event_id"), "place")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY substr(sha256('3:' || CAST(o_orderkey AS VARCHAR)), 1, 32)) AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN k <= floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r
""")
def exact_split(spark, sf_dir):
    return ranks.exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.1, seed=3)


@query(f"""
WITH b AS ({BOXES}), p AS (SELECT DISTINCT page // 4 AS doc, page % 4 AS page, 600 + page % 3 AS width, 800 + page % 5 AS height FROM b), i AS (SELECT *, row_number() OVER (ORDER BY doc, page) AS image_id FROM p),
a AS (SELECT i.image_id, b.ord, CASE b.label % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 5 END AS category_id, b.x0 * width AS x, (b.y1 - b.y0) * height AS h, (b.x1 - b.x0) * width AS w FROM b JOIN i ON i.doc = b.page // 4 AND i.page = b.page % 4 WHERE b.label % 4 < 3)
SELECT image_id, ord, CAST(category_id AS INTEGER) AS category_id, round_even(x, 5) AS x, round_even(w * h, 4) AS area, row_number() OVER (ORDER BY image_id, ord) AS annotation_id FROM a
""")
def coco_ids(spark, sf_dir):
    """Boxes as labels of four kinds, one of them unknown."""
    rows = _boxes(spark, sf_dir).withColumn("number", F.col("page")).withColumn("doc", F.expr("page div 4")).withColumn("page", F.col("page") % 4)
    names = F.element_at(F.array(*[F.lit(k) for k in ("Table", "TEXT", "figure", "stamp")]), (F.col("label") % 4 + 1).cast("int"))
    images = rows.select("doc", "page", (600 + F.col("number") % 3).alias("width"), (800 + F.col("number") % 5).alias("height")).distinct()
    _, annotations = ranks.coco_tables(rows.withColumn("label", names), images, {"text": 1, "table": 2, "figure": 5})
    return annotations.select("image_id", "ord", "category_id", F.bround("x", 5).alias("x"), F.bround("area", 4).alias("area"), "annotation_id")


@query(r"""
WITH s AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, l_returnflag = 'R' AS tab, repeat(CAST(l_partkey AS VARCHAR) || 'x', CASE WHEN l_tax > 0.06 THEN 9 ELSE 1 END) AS t FROM lineitem),
n AS (SELECT *, count(*) FILTER (WHERE tab) OVER (PARTITION BY d ORDER BY o ROWS UNBOUNDED PRECEDING) AS k FROM s), g AS (SELECT d, unnest(range(max(k) + 1)) AS k FROM n GROUP BY d),
m AS (SELECT g.d, g.k, coalesce(string_agg(t, '' ORDER BY o) FILTER (WHERE NOT tab), '') AS t, count(*) FILTER (WHERE NOT tab) AS spans FROM g LEFT JOIN n ON n.d = g.d AND n.k = g.k GROUP BY g.d, g.k),
p AS (SELECT *, CASE WHEN k BETWEEN 1 AND 1 + d % 3 THEN (36 + d % 40 * 36 + CASE k WHEN 1 THEN 1000 WHEN 2 THEN 400 ELSE 2000 END) / 1440.0::DOUBLE END AS pos, CASE WHEN (d + k) % 7 = 0 THEN 'right' WHEN (d + k) % 7 = 3 THEN 'center' ELSE 'left' END AS al FROM m),
q AS (SELECT d, bool_or((d + k) % 7 IN (0, 3)) AS over_ FROM (SELECT DISTINCT d, unnest(range(1, 2 + d % 3)) AS k FROM m) GROUP BY d),
x AS (SELECT p.*, over_, pos - greatest(0, coalesce(max(pos) OVER (PARTITION BY p.d ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS jump, max(k) OVER (PARTITION BY p.d) AS last FROM p JOIN q ON q.d = p.d),
y AS (SELECT d, k, over_, CASE WHEN over_ THEN CASE WHEN k = 0 THEN '\noindent' || CASE WHEN spans > 0 THEN '\makebox[0pt][l]{' || t || '}' ELSE '' END WHEN pos IS NOT NULL THEN CASE WHEN jump > 0 THEN printf('\hspace*{%.2fin}', jump) ELSE '' END || CASE WHEN t <> '' THEN '\makebox[0pt][' || CASE al WHEN 'right' THEN 'r' WHEN 'center' THEN 'c' ELSE 'l' END || ']{' || t || '}' ELSE '' END ELSE '' END
  ELSE CASE WHEN k = 0 THEN t WHEN pos IS NOT NULL THEN printf('\tabto{%.2fin}', pos) || t WHEN k = last AND length(t) < 30 THEN '\hfill ' || t ELSE '\quad ' || t END END AS tex FROM x)
SELECT d AS l_orderkey, CASE WHEN bool_or(over_) THEN 'overlay' ELSE 'flow' END AS method, string_agg(tex, '' ORDER BY k) AS tex FROM y GROUP BY d
""")
def tabbed_paragraphs(spark, sf_dir):
    """Orders as paragraphs, returned items as tabs; one to three stops, of which the second lies before the first."""
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    text = F.repeat(F.concat(F.col("l_partkey").cast("string"), F.lit("x")), F.when(F.col("l_tax") > 0.06, 9).otherwise(1))
    spans = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("block"), order.alias("ord"), text.alias("text"), (F.col("l_returnflag") == "R").alias("is_tab"))
    d, k = F.col("block"), F.col("k")
    stops = spans.select("doc_id", "block").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), (1 + d % 3).cast("int"))))
    stops = stops.withColumn("position", 36 + d % 40 * 36 + F.when(k == 1, 1000).when(k == 2, 400).otherwise(2000)).withColumn("alignment", F.when((d + k) % 7 == 0, "right").when((d + k) % 7 == 3, "center").otherwise("left"))
    return tabs.tabbed(spans, stops).select(F.col("block").alias("l_orderkey"), "method", "tex")


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1 AS new FROM events)
SELECT event_id, event_type, count(*) FILTER (WHERE new) OVER w AS visitors, count(*) OVER w AS conversions FROM f WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_usage(spark, sf_dir):
    return cooldown.running_usage(table(spark, sf_dir, "events"))


@query("""
WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), l AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, least(255, CAST(floor(abs(v::DOUBLE) * 1500) AS BIGINT)) AS p FROM e),
r AS (SELECT vec_id, (63 - i) // 7 AS y, (63 - i) % 7 AS x, least(255, CAST(floor(abs(v::DOUBLE) * 1500) AS BIGINT)) AS p FROM e WHERE i > 0),
o AS (SELECT n, o, n / m::DOUBLE AS s, (o + 0.5::DOUBLE) * (n / m::DOUBLE) AS c FROM (SELECT n, m, unnest(range(m)) AS o FROM (VALUES (8, 7), (9, 8)) g(n, m))),
t AS (SELECT n, o, x, (x - c + 0.5::DOUBLE) / s AS t FROM (SELECT *, unnest(range(greatest(0, CAST(trunc(c - 3 * s + 0.5::DOUBLE) AS BIGINT)), least(n, CAST(trunc(c + 3 * s + 0.5::DOUBLE) AS BIGINT)))) AS x FROM o)),
w AS (SELECT n, o, x, CASE WHEN t = 0 THEN 1 WHEN t >= -3 AND t < 3 THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0 END AS w FROM t), u AS (SELECT n, o, x, w / sum(w) OVER (PARTITION BY n, o) AS w FROM w),
k AS (SELECT n, o, x, CAST(trunc(w * 4194304 + CASE WHEN w < 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END) AS BIGINT) AS k FROM u),
a AS (SELECT vec_id, y, o AS x, greatest(0, least(255, CAST(sum(p * k) + 2097152 AS BIGINT) >> 22)) AS p FROM l JOIN k ON k.n = 8 AND k.x = l.x GROUP BY vec_id, y, o),
b AS (SELECT vec_id, o AS y, r.x, greatest(0, least(255, CAST(sum(p * k) + 2097152 AS BIGINT) >> 22)) AS p FROM r JOIN k ON k.n = 9 AND k.x = r.y GROUP BY vec_id, o, r.x),
d AS (SELECT vec_id, y, x, abs(a.p - b.p) AS d, b.p AS p FROM a JOIN b USING (vec_id, y, x))
SELECT d.vec_id, string_agg(CAST(d AS VARCHAR), ',' ORDER BY y, x) AS diff, round_even(avg(d), 6) AS mean, CAST(max(d) AS INTEGER) AS most, any_value(c.part) AS part FROM d
JOIN (SELECT vec_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY y, x) AS part FROM l WHERE y BETWEEN 1 AND 4 AND x BETWEEN 3 AND 7 GROUP BY vec_id) c ON c.vec_id = d.vec_id GROUP BY d.vec_id
""")
def image_diffs(spark, sf_dir):
    """Each vector as an image of 8 by 8, compared with its end in reverse as one of 9 rows of 7; and a part of the first one."""
    grey = F.transform("embedding", lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 1500).cast("int")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("p"), F.reverse(grey).alias("q"))
    cut = lambda c, h, w: F.array(*[F.slice(c, 1 + k * w, w) for k in range(h)])
    images = rows.select("vec_id", cut("p", 8, 8).alias("a"), cut("q", 9, 7).alias("b"))
    joined = lambda c: F.array_join(F.flatten(c).cast("array<string>"), ",")
    part = compare.crop(F.col("a"), *map(F.lit, (0.4, 0.2, 0.95, 0.6)))
    found = images.select("vec_id", compare.difference("a", "b").alias("d"), joined(part).alias("part"))
    return found.select("vec_id", joined("d.diff").alias("diff"), F.bround("d.mean", 6).alias("mean"), "d.most", "part")


@query()
def augmented_pages(spark, sf_dir):
    """Vectors as images of 4 by 5 pixels with the boxes of their page, through all steps. What is drawn follows from hashes that SQL lacks; tests compare
    with plain loops."""
    grey = F.transform("embedding", lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 1500).cast("int")))
    pixel = lambda y, x: F.slice("p", 1 + 3 * (5 * y + x), 3)
    images = table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("p")).select("vec_id", F.array(*[F.array(*[pixel(y, x) for x in range(5)]) for y in range(4)]).alias("image"))
    rows = _boxes(spark, sf_dir).groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("label").cast("string").alias("label"), *[F.least(F.col(c), F.lit(1.0)).alias(c) for c in ("x0", "y0", "x1", "y1")]))).alias("boxes"))
    pages = images.withColumn("page", F.expr("vec_id div 10")).join(rows, "page")
    done = augment.augmented(pages, tuple(augment.STEPS), F.col("vec_id"), seed=1)
    return done.select("vec_id", F.array_join(F.flatten(F.flatten("image")).cast("array<string>"), ",").alias("pixels"), F.size("boxes").alias("n_boxes"), F.bround(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["x1"] - b["x0"]), 6).alias("width"))
