"""Paragraphs with tabs as LaTeX: segments between tabs, each at its tab stop.

spans have doc_id, block, ord, text (already escaped) and is_tab; stops have doc_id, block, k (from 1) and position in twips, and alignment.
Segment 0 is before the first tab, the k-th is after the k-th tab and belongs to the k-th stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.shared import dealt, shares

KEY = ("doc_id", "block")
#: How a box is aligned, how long the last segment may be to be moved to the right edge, and twips in an inch.
LETTERS = {"right": "r", "center": "c"}
SHORT = 30
INCH = 1440.0


def two_places(x: Column) -> Column:
    """A number from 0 on with two places as C prints it: by its binary value, exact ties to even."""

    whole = F.floor(x)

    def by(bits: int) -> Column:
        # what is left over, times a power of two, is a whole number below 2 ** 58; 25 / 2 ** (bits - 2) makes it hundredths
        n = ((x - whole) * float(2**bits)).cast("long") * 25
        down, rest = F.shiftright(n, bits - 2), n.bitwiseAND(F.lit(2 ** (bits - 2) - 1))
        up = (rest > 2 ** (bits - 3)) | ((rest == 2 ** (bits - 3)) & (down % 2 == 1))
        return down + F.when(up, 1).otherwise(0)

    # the last bit of a number from 1/256 on stands for 2 ** -60 at least; smaller ones are 0.00
    hundredths = whole * 100 + F.when(x < 0.25, by(60)).otherwise(by(58))
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def segments(spans: DataFrame) -> DataFrame:
    """doc_id, block, k, text, n_spans of all segments, empty ones too."""
    w = Window.partitionBy(*KEY).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(spans, *KEY).withColumn("k", F.count_if("is_tab").over(w).cast("int"))
    said = F.filter(F.array_sort(F.collect_list(F.struct("ord", "is_tab", F.coalesce("text", F.lit("")).alias("t")))), lambda s: ~s["is_tab"])
    found = rows.groupBy(*KEY, "k").agg(said.alias("__s")).select(*KEY, "k", F.array_join(F.transform("__s", lambda s: s["t"]), "").alias("text"), F.size("__s").alias("n_spans"))
    # segment 0 has no row where a tab comes first; each later one has its tab's
    whole = found.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", "text", "n_spans"))).alias("__s"))
    first = F.array(F.struct(F.lit(0).alias("k"), F.lit("").alias("text"), F.lit(0).alias("n_spans")))
    return whole.select(*KEY, F.inline(F.when(F.col("__s")[0]["k"] > 0, F.concat(first, "__s")).otherwise(F.col("__s"))))


def tabbed(spans: DataFrame, stops: DataFrame, fill_short_only: bool = True) -> DataFrame:
    """doc_id, block, method and tex of each paragraph with spans.

    overlay, for paragraphs with a right or centred stop: boxes without width, at places reached by jumps. The running place only moves on: to the
    stop if that lies beyond all stops before, a maximum over the segments so far. Segments without a stop have no place and are left out.
    flow, for the others: each segment after a jump to its stop; without a stop the last one, if it has fewer than SHORT
    characters, goes to the right edge, others follow after a space. fill_short_only = False sends all of these to the right edge."""
    marks = dealt(stops.select(*KEY, F.col("k").cast("int").alias("k"), F.col("position").cast("double").alias("position"), "alignment"), *KEY, n=shares(spans))
    stopped = marks.groupBy(*KEY).agg(F.collect_list(F.struct("k", "position", "alignment")).alias("__stops"), F.bool_or(F.coalesce(F.col("alignment").isin(*LETTERS), F.lit(False))).alias("overlay"))
    rows = segments(spans).join(stopped, [*KEY], "left").withColumn("overlay", F.coalesce("overlay", F.lit(False)))
    rows = rows.withColumn("__stop", F.explode_outer(F.filter("__stops", lambda s: s["k"] == F.col("k")))).select(*KEY, "k", "text", "n_spans", "overlay", "__stop.position", "__stop.alignment")
    order = Window.partitionBy(*KEY).orderBy("k")
    at = F.col("position") / INCH
    before = F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("k") > 0, at)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("__by", at - before).withColumn("__last", F.col("k") == F.max("k").over(Window.partitionBy(*KEY)))
    letter = F.lit("l")
    for name, short in LETTERS.items():
        letter = F.when(F.col("alignment") == name, F.lit(short)).otherwise(letter)
    box = lambda a: F.concat(F.lit("\\makebox[0pt]["), a, F.lit("]{"), F.col("text"), F.lit("}"))
    has_stop = F.col("position").isNotNull()
    jump = F.when(F.col("__by") > 0, F.concat(F.lit("\\hspace*{"), two_places(F.greatest(F.col("__by"), F.lit(0.0))), F.lit("in}"))).otherwise("")
    overlay = F.when(F.col("k") == 0, F.concat(F.lit("\\noindent"), F.when(F.col("n_spans") > 0, box(F.lit("l"))).otherwise(""))).when(has_stop, F.concat(jump, F.when(F.col("text") != "", box(letter)).otherwise(""))).otherwise("")
    to_edge = F.col("__last") & (F.length("text") < SHORT) if fill_short_only else F.lit(True)
    flow = F.when(F.col("k") == 0, F.col("text")).when(has_stop, F.concat(F.lit("\\tabto{"), two_places(F.greatest(at, F.lit(0.0))), F.lit("in}"), F.col("text")))
    flow = flow.otherwise(F.concat(F.when(to_edge, "\\hfill ").otherwise("\\quad "), F.col("text")))
    rows = rows.withColumn("__tex", F.when(F.col("overlay"), overlay).otherwise(flow))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "__tex"))), lambda s: s["__tex"]), "")
    return rows.groupBy(*KEY).agg(F.when(F.bool_or("overlay"), "overlay").otherwise("flow").alias("method"), joined.alias("tex"))
