"""Which places of a table's grid its cells take: columns by prefix sums of spans, merged cells of any height by runs.

A table is named by the columns `by`. Cells have row_idx, cell_idx and col_span, and v_merge and v_restart (is the cell part of a vertical merge, and
does it begin one). All windows are over one row or one grid column of one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How cells are aligned that say so in another way.
ALIGNMENTS = {"center": "center", "bottom": "bottom", "both": "center", "distributed": "center", "justify": "center"}


def alignment(value: Column) -> Column:
    """top, center or bottom."""
    out = F.lit("top")
    for name, meant in ALIGNMENTS.items():
        out = F.when(value == name, F.lit(meant)).otherwise(out)
    return out


def placed(cells: DataFrame, by: list[str], before: Column | None = None) -> DataFrame:
    """cells with `grid_col`, the grid column they begin in: the spans of the cells before them in their row, and what the row
    leaves out at its start (`before`). A missing span, or one below 1, counts as 1."""
    span = F.greatest(F.coalesce(F.col("col_span").cast("int"), F.lit(1)), F.lit(1))
    row = Window.partitionBy(*by, "row_idx").orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("col_span", span)
    first = F.coalesce(before, F.lit(0)) if before is not None else F.lit(0)
    return cells.withColumn("grid_col", (F.coalesce(F.sum("col_span").over(row), F.lit(0)) + first).cast("int"))


def rectangles(cells: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """One row a rectangle: by, row_idx, grid_col, cell_idx (those of its first cell), col_span, row_span, and `text`, the first cell's
    text and those of the cells merged into it, by line ends, as far as they have one.

    cells are `placed`. A cell that continues a merge belongs to the cell above if that is in the row just above, begins in the same grid column and
    has the same span; else there is nothing to continue and it is a rectangle of its own. Rows are numbered without gaps; a missing one
    ends a merge."""
    column = Window.partitionBy(*by, "grid_col").orderBy("row_idx")
    goes_on = F.coalesce(F.col("v_merge"), F.lit(False)) & ~F.coalesce(F.col("v_restart"), F.lit(False))
    may_go_on = F.coalesce(F.lag("v_merge").over(column), F.lit(False)) & (F.lag("row_idx").over(column) == F.col("row_idx") - 1) & (F.lag("col_span").over(column) == F.col("col_span"))
    begun = cells.withColumn("__begins", ~(goes_on & F.coalesce(may_go_on, F.lit(False))))
    begun = begun.withColumn("__run", F.count_if("__begins").over(column.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "row_idx").alias(c)
    kept = F.filter(F.array_sort(F.collect_list(F.struct("row_idx", F.col(text).alias("t")))), lambda s: F.coalesce(s["t"], F.lit("")) != "")
    found = begun.groupBy(*by, "grid_col", "__run").agg(
        F.min("row_idx").alias("row_idx"), first("cell_idx"), first("col_span"), F.count(F.lit(1)).cast("int").alias("row_span"), F.array_join(F.transform(kept, lambda s: s["t"]), "\n").alias(text),
        *[first(c) for c in cells.columns if c not in {*by, "grid_col", "row_idx", "cell_idx", "col_span", "row_span", "v_merge", "v_restart", text}],
    )
    return found.drop("__run")


def sized(found: DataFrame, widths: Column, width: str = "width") -> DataFrame:
    """Rectangles with the sum of the widths of their grid columns; columns that the grid doesn't name add nothing, and a rectangle that
    has none of them gets null. `widths` is an array column."""
    own = F.slice(widths, F.col("grid_col") + 1, F.col("col_span"))
    return found.withColumn(width, F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, w: a + F.coalesce(w.cast("double"), F.lit(0.0)))))


def occupancy(found: DataFrame, by: list[str]) -> DataFrame:
    """One row for each place of the grid that a rectangle takes: by, place_row, place_col (from the rectangle's row on, one after the other), the
    rectangle's row_idx, grid_col and cell_idx, and `covered`, whether the place is another one than its first."""
    down, across = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name) for c, name in (("row_span", "__i"), ("col_span", "__j")))
    places = found.select(*by, "row_idx", "grid_col", "cell_idx", "col_span", down).select(*by, "row_idx", "grid_col", "cell_idx", "__i", across)
    return places.select(*by, (F.col("row_idx") + F.col("__i")).alias("place_row"), (F.col("grid_col") + F.col("__j")).alias("place_col"), "row_idx", "grid_col", "cell_idx", ((F.col("__i") > 0) | (F.col("__j") > 0)).alias("covered"))


def problems(found: DataFrame, by: list[str]) -> DataFrame:
    """Tables whose rectangles overlap or leave places open: by, n_rows, n_columns, n_places (taken), n_twice (taken more than once) and n_open."""
    places = occupancy(found, by).groupBy(*by, "place_row", "place_col").agg(F.count(F.lit(1)).alias("n"))
    tables = places.groupBy(*by).agg((F.max("place_row") + 1).alias("n_rows"), (F.max("place_col") + 1).alias("n_columns"), F.count(F.lit(1)).alias("n_places"), F.count_if(F.col("n") > 1).alias("n_twice"))
    return tables.withColumn("n_open", F.col("n_rows").cast("long") * F.col("n_columns") - F.col("n_places"))


def cell_paragraphs(found: DataFrame, blocks: DataFrame, by: list[str], cell: str = "cell_id") -> DataFrame:
    """The paragraphs inside each rectangle's first cell, with `place` from 1: by, row_idx, grid_col, and the blocks' columns. blocks have `parent`,
    the cell they stand in, `ord`, and those of `by` that name their document."""
    keys = [c for c in by if c in blocks.columns]
    named = [c for c in blocks.columns if c not in {*keys, "parent"}]
    inside = found.select(*by, F.col(cell).alias("parent"), "row_idx", "grid_col").join(blocks, [*keys, "parent"])
    place = F.row_number().over(Window.partitionBy(*by, "row_idx", "grid_col").orderBy("ord"))
    return inside.withColumn("place", place).select(*by, "row_idx", "grid_col", "place", *named)
