"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected copies are its source's target over its source's
size. Along a fixed order of the source's documents the expected copies are summed up, one offset is added, and a
document is emitted once for each integer that its stretch of the sum crosses. The order is by size, so the words
taken differ from the target by about one document at most; equal sizes are ordered by a hash of the id.

As a source's documents all have the same expected copies, the prefix sum at a document is its rank times that
number. Ranks come from counts: of (source, size), then of (source, size, bucket of the id's hash), then within
a bucket. So no window holds more than one source's distinct sizes or one bucket, however large a source is. The
targets' running sums over all sources are taken part by part, so sources may be as many as hosts.

Targets. Sources in code point order, null last, weigh `weights`, repeating; together they get `share` times all
sizes. A target stops at `most` times its source's size and what is above is dealt to the others by weight, until
none is above: target = min(most * size, weight * level) for one level.

Defined cases: a null, empty or white text has size 0 and its copies take no words. A null source is a source.
Repeated rows are rows of their own (equal ids and sizes in one source are ordered arbitrarily but alike, so the
result as a set of rows is the same in every run). An empty table gives an empty result. Other columns pass
through; columns named like an output are replaced.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import cut

#: Digits of the id's hash that make its bucket: 4096 buckets.
BUCKET_DIGITS = 3
WEIGHTS = (3, 1, 2)
SEED = 7
OFFSET_BITS = 20


def offset(seed: int) -> float:
    """The number from 0 to 1 that is added to every source's prefix sum: an exact binary fraction by the seed."""
    return zlib.crc32(str(seed).encode()) % (1 << OFFSET_BITS) / (1 << OFFSET_BITS)


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) for the table (source, source_size). share is a fraction of all sizes."""
    up, down = share
    ordered = running(sizes, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    # the level is reached at the first source, by size over weight, that stays below its limit
    by_level = [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    rows = running(ordered.withColumn("weight", weight).drop("place"), by_level, {"below": F.col("source_size"), "before": F.col("weight")})
    every = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    everything, weighs = F.lit(every["size"] or 0).cast("long"), F.lit(every["weight"] or 0).cast("long")
    gap, left = up * everything - down * most * F.col("below"), weighs - F.col("before")
    rows = rows.withColumn("free", gap * F.col("weight") <= down * most * F.col("source_size") * left)
    first = rows.where("free").agg(F.min(F.struct((F.col("source_size") / F.col("weight")).alias("r"), "below", left.alias("left"))).alias("f")).first()["f"]
    below, rest = (F.lit(first[n] if first else None).cast("long") for n in ("below", "left"))  # a small literal would be an int, and its multiples overflow
    level = F.col("weight") * (up * everything - down * most * below) / (F.lit(float(down)) * rest)
    target = F.when(F.col("free"), level).otherwise(F.col("source_size").cast("double") * most)
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums of some columns over all rows that come before in `order`. The rows are sorted into parts, the parts' totals are
    added up on the driver, one row for each part, and only a part is in a window, however many rows there are."""
    placed = rows.orderBy(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("__part"), *[c.cast("long").alias(f"__{n}") for n, c in sums.items()]))
    totals = placed.groupBy("__part").agg(*[F.sum(f"__{n}").alias(n) for n in sums]).orderBy("__part").collect()
    so_far, starts = dict.fromkeys(sums, 0), []
    for t in totals:
        starts.append((t["__part"], *so_far.values()))
        so_far = {n: v + t[n] for n, v in so_far.items()}
    starts = placed.sparkSession.createDataFrame(starts, "__part int, " + ", ".join(f"__from_{n} long" for n in sums))
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.join(F.broadcast(starts), "__part")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return inside.select(*kept, *[(F.col(f"__from_{n}") + F.coalesce(F.sum(f"__{n}").over(before), F.lit(0))).alias(n) for n in sums])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", size_col: str | None = None, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document). The size is the number of
    words of text_col, or size_col where that is given."""
    measure = F.col(size_col).cast("long") if size_col else n_words(F.col(text_col))
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], measure.alias("size"), F.coalesce(F.concat(F.lit("1"), F.col(source_col)), F.lit("0")).alias("__s"))
    rows = rows.withColumn("__key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    place = ["__s", "size", "__bucket"]
    counted = cut(rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n")))  # read by several jobs
    by_size = counted.groupBy("__s", "size").agg(F.sum("n").alias("n"))
    by_source = by_size.groupBy("__s").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    named = by_source.select(F.when(F.col("__s") != "0", F.expr("substring(__s, 2)")).alias("source"), "source_size")
    goals = targets(named, weights, share, most).select(F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("__s"), "source_size", "target")
    upto_here = Window.unboundedPreceding, -1
    starts = by_size.select("__s", "size", F.coalesce(F.sum("n").over(Window.partitionBy("__s").orderBy("size").rowsBetween(*upto_here)), F.lit(0)).alias("start"))
    inner = F.sum("n").over(Window.partitionBy("__s", "size").orderBy("__bucket").rowsBetween(*upto_here))
    offsets = counted.select(*place, F.coalesce(inner, F.lit(0)).alias("inner")).join(starts, ["__s", "size"]).join(goals, "__s")
    offsets = offsets.select(*place, (F.col("start") + F.col("inner")).alias("__start"), "source_size", "target")
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*place).orderBy("__key", F.col(id_col))))
    met = ranked.join(offsets, place)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(rate * k + F.lit(offset(seed)))
    k = F.col("__start") + F.col("__rank")
    return met.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", (upto(k) - upto(k - 1)).cast("long").alias("copies"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as mix() takes it, with docs' columns."""
    some = mix(docs, **how).where("copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))))
    return some.select(*[F.col(f"`{c}`") for c in docs.columns])
