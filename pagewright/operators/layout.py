"""Page layout from spans and boxes: reading order, columns, gaps, spacing, fonts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reading_order(spans: DataFrame, by: list[str], column: Column | None = None) -> DataFrame:
    """spans with `place`: by column, then height rounded to a tenth, then x."""
    order = [column if column is not None else F.lit(0), F.bround("y0", 1), F.col("x0")]
    return spans.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def column_index(x: Column, boundaries: Column) -> Column:
    """How many boundaries are at or left of x, both in one frame of reference."""
    return F.size(F.filter(boundaries, lambda b: b <= x))


def two_means(values: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """The exact split of each group's values into two clusters with the least squared error: the size of the left one,
    both means and the boundary halfway. Every split of the sorted values is tried by prefix sums. Equal values are
    summed up before the window, so that holds a group's distinct values only."""
    points = values.groupBy(*by, x).agg(F.count(F.lit(1)).alias("c"))
    points = points.withColumn("s", F.col(x) * F.col("c"))
    upto = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    cut = points.select(*by, F.col(x).alias("left_max"), F.lead(x).over(Window.partitionBy(*by).orderBy(x)).alias("right_min"), F.sum("c").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"), F.sum("c").over(whole).alias("n"), F.sum("s").over(whole).alias("st"))
    cut = cut.where("right_min is not null").withColumn("nr", F.col("n") - F.col("nl")).withColumn("sr", F.col("st") - F.col("sl"))
    between = F.col("sl") * F.col("sl") / F.col("nl") + F.col("sr") * F.col("sr") / F.col("nr")  # the squared error falls as this rises
    best = cut.groupBy(*by).agg(F.max_by(F.struct("nl", "n", "left_max", "right_min", (F.col("sl") / F.col("nl")).alias("left_mean"), (F.col("sr") / F.col("nr")).alias("right_mean")), F.struct(between.alias("b"), -F.col("nl"))).alias("r"))
    return best.select(*by, "r.*", ((F.col("r.left_mean") + F.col("r.right_mean")) / 2).alias("boundary"))


def is_two_column(split: DataFrame, width: float = 1.0) -> Column:
    """Guards on a split: more than 10 blocks, centres apart by more than .15 of the width, the boundary well inside, and, where
    bridging() has counted them, fewer than 5 % of the blocks across it."""
    gap = F.col("right_mean") - F.col("left_mean")
    apart = (F.col("n") > 10) & (gap > 0.15 * width) & F.col("boundary").between(0.15 * width, 0.85 * width)
    return apart & (F.col("n_bridging") < 0.05 * F.col("n")) if "n_bridging" in split.columns else apart


def bridging(split: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """split with `n_bridging`, the blocks (x0, x1) that lie across its boundary."""
    met = blocks.join(split.select(*by, "boundary"), by).where((F.col("x0") < F.col("boundary")) & (F.col("x1") > F.col("boundary")))
    return split.join(met.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bridging")), by, "left").na.fill(0, ["n_bridging"])


def low_coverage_runs(spans: DataFrame, by: list[str], bins: int = 200, share: float = 0.25) -> DataFrame:
    """Runs of bins between 10 % and 90 % of the width which fewer spans cover than `share` of the peak. A run that is
    still open at 90 % is dropped."""
    low, high = bins // 10, bins * 9 // 10
    at = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(bins - 1)).cast("int")
    covered = spans.withColumn("b0", at(F.floor(F.col("x0") * bins))).withColumn("b1", at(F.ceil(F.col("x1") * bins))).where("b1 > b0")
    steps = covered.select(*by, F.col("b0").alias("bin"), F.lit(1).alias("d")).unionAll(covered.select(*by, F.col("b1").alias("bin"), F.lit(-1).alias("d")))
    counted = steps.groupBy(*by, "bin").agg(F.sum("d").alias("d"))
    every = spans.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    cover = every.join(counted, [*by, "bin"], "left").na.fill(0, ["d"])
    cover = cover.withColumn("n", F.sum("d").over(Window.partitionBy(*by).orderBy("bin")))
    limit = F.floor(share * F.max("n").over(Window.partitionBy(*by)))
    inside = cover.withColumn("limit", limit).where(F.col("bin").between(low, high - 1)).withColumn("is_low", F.col("n") <= F.col("limit"))
    order = Window.partitionBy(*by).orderBy("bin")
    islands = inside.withColumn("run", F.sum((~F.col("is_low")).cast("int")).over(order)).where("is_low")
    runs = islands.groupBy(*by, "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count(F.lit(1)).alias("n_bins"))
    return runs.where(F.col("last_bin") < high - 1).drop("run")


def widest_gap(runs: DataFrame, by: list[str]) -> DataFrame:
    """Each group's longest run, the first of equals."""
    return runs.groupBy(*by).agg(F.max_by(F.struct("first_bin", "last_bin", "n_bins"), F.struct("n_bins", -F.col("first_bin"))).alias("r")).select(*by, "r.*")


def page_patterns(spans: DataFrame, by: list[str], bins: int = 200) -> DataFrame:
    """Each group's layout from its widest gap (the first of equals) of more than .7 % of the content, which lies between the first
    percentile of x0 and the last of x1: a wide gap beside the middle parts a sidebar from the rest, a narrow one in the middle
    two columns. spans: x0 and x1 as shares of the page's width. Groups of fewer than five spans have one column."""
    bounds = spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("x0", 0.01).alias("left"), F.percentile("x1", 0.99).alias("right"))
    a, b = F.greatest("left", F.col("first_bin") / bins), F.least("right", (F.col("last_bin") + 1) / bins)
    wide = F.col("right") - F.col("left")
    found = low_coverage_runs(spans, by, bins).join(bounds.where((F.col("n") >= 5) & (wide > 0)), by)
    found = found.select(*by, "first_bin", ((b - a) / wide).alias("gap"), ((a - F.col("left")) / wide).alias("before"), ((a + b) / 2).alias("centre")).where("gap > 0.007")
    best = found.groupBy(*by).agg(F.max_by(F.struct("gap", "before", "centre"), F.struct("gap", -F.col("first_bin"))).alias("__g"))
    gap, before, centre = F.col("__g.gap"), F.col("__g.before"), F.col("__g.centre")
    sidebar = gap > 0.1
    right, equal = sidebar & (centre > 0.55), ~sidebar & (centre > 0.4) & (centre < 0.6)
    after = 1 - before - gap
    pattern = F.when(gap.isNull(), "single_column").when(right, "sidebar_right").when(sidebar, "sidebar_left").when(equal, "two_col_equal").otherwise("single_column")
    share = F.when(gap.isNull(), 0.0).when(right, after).when(sidebar, before).when(equal, 0.48).otherwise(0.0)
    main = F.when(gap.isNull(), 1.0).when(right, before).when(sidebar, after).when(equal, 0.48).otherwise(1.0)
    met = bounds.select(*by).join(best, by, "left")
    return met.select(*by, pattern.alias("pattern"), share.alias("sidebar_share"), F.when(sidebar | equal, gap).otherwise(0.0).alias("gap_share"), main.alias("main_share"))


def column_vote(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Two columns if at least three narrow blocks lie on either side."""
    narrow, left = F.col("x1") - F.col("x0") < 0.6, (F.col("x0") + F.col("x1")) / 2 < 0.5
    votes = blocks.groupBy(*by).agg(F.count_if(narrow & left).alias("n_left"), F.count_if(narrow & ~left).alias("n_right"))
    return votes.withColumn("columns", F.when((F.col("n_left") >= 3) & (F.col("n_right") >= 3), 2).otherwise(1))


def weighted_mode(rows: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """The value with the most weight; of equals, the larger."""
    summed = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("w"))
    return summed.groupBy(*by).agg(F.max_by(value, F.struct("w", value)).alias("mode"), F.max("w").alias("weight"))


def first_seen_mode(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value; of equals, the one seen first, then the larger."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"), value)).alias("mode"), F.max("n").alias("n"))


def gaps(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """Differences of each group's sorted distinct positions."""
    distinct = rows.select(*by, position).distinct()
    return distinct.withColumn("gap", F.col(position) - F.lag(position).over(Window.partitionBy(*by).orderBy(position))).where("gap is not null")


def spacing_mode(rows: DataFrame, by: list[str], position: str, low: float, high: float, step: float) -> DataFrame:
    """The most frequent gap within bounds, rounded to `step`; of equals, the smaller."""
    rounded = gaps(rows, by, position).where(F.col("gap").between(low, high)).withColumn("gap", F.bround(F.col("gap") / step, 0) * step)
    counted = rounded.groupBy(*by, "gap").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("spacing"), F.max("n").alias("n"))


def dominant_font(spans: DataFrame, by: list[str]) -> DataFrame:
    """The font with the most characters in texts of more than three; of equals, the first."""
    long = spans.where(F.length("text") > 3).groupBy(*by, "font").agg(F.sum(F.length("text")).alias("w"), F.min("ord").alias("first"))
    return long.groupBy(*by).agg(F.max_by("font", F.struct("w", -F.col("first"))).alias("font"))


def page_metrics(spans: DataFrame, pages: int = 3) -> DataFrame:
    """Per document and side: mean font size, line gap within (5, 30) and block gap within (0, 100) of the first pages."""
    some = spans.where(F.col("page") < pages)
    page, block = Window.partitionBy("doc_id", "side", "page").orderBy("ord"), Window.partitionBy("doc_id", "side", "page", "block").orderBy("ord")
    line, jump = F.col("y0") - F.lag("y1").over(block), F.col("y0") - F.lag("y1").over(page)
    rows = some.withColumn("line", F.col("y0") - F.lag("y0").over(block)).withColumn("jump", F.when(F.lag("block").over(page) != F.col("block"), jump)).withColumn("inner", line)
    inside = lambda c, a, b: F.avg(F.when((F.col(c) > a) & (F.col(c) < b), F.col(c)))
    return rows.groupBy("doc_id", "side").agg(F.avg("font_size").alias("font_size"), inside("line", 5, 30).alias("line_gap"), inside("jump", 0, 100).alias("block_gap"), (F.max("page") + 1).alias("pages"))


def header_rows(rows: DataFrame, height: Column) -> DataFrame:
    """Rows of a grid whose running height stays below the header's; one row at least is left. Missing heights count as
    the table's mean."""
    table = Window.partitionBy("doc_id", "table_id")
    filled = rows.withColumn("h", F.coalesce("height", F.avg("height").over(table)))
    running = filled.withColumn("upto", F.sum("h").over(table.orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)))
    return running.withColumn("strip", (F.coalesce("upto", F.lit(0.0)) < height) & (F.col("row_idx") < F.max("row_idx").over(table)))
