"""Exact ranks without a task that sees all rows: splits of an exact size, and running ids without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import geometry as g
from pagewright.shared import cut

#: Hex digits by which a prefix is refined: 4096 counts at most reach the driver at a time.
STEP = 3


def order_key(rows: DataFrame, key: Column, seed: int) -> Column:
    """64 hex digits by which rows are put in a random but fixed order: a hash of seed and key, then one of seed and the whole row, so that only rows
    which agree in all columns tie."""
    digest = lambda c: F.sha2(F.concat(F.lit(f"{seed}:"), c).cast("binary"), 256)
    # both are needed: rows with one key are told apart by the rest
    return F.concat(F.substring(digest(F.coalesce(key.cast("string"), F.lit(""))), 1, 32), F.substring(digest(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})), 1, 32))


def threshold(keys: DataFrame, wanted: int) -> tuple[str, int]:
    """(prefix, rest): the `wanted` least rows are those whose `__k` is below the prefix, and `rest` of the rows that begin with it. The prefix is
    refined from counts by a few digits at a time, always inside the one group that the border runs through, until that group has no more
    than 16 ** STEP rows, whose keys are looked at, or one key. No round brings more rows than that to the driver."""
    prefix, left = "", wanted
    while len(prefix) < 64:
        group = keys.where(F.col("__k").startswith(prefix)) if prefix else keys
        counts = sorted(map(tuple, group.groupBy(F.substring("__k", 1, len(prefix) + STEP).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()))
        for p, n in counts:
            if left < n:
                prefix = p
                break
            left -= n
        else:
            return "g", 0  # all rows: hex digits sort before it
        if left == 0:
            return prefix, 0
        if n <= 16**STEP:
            few = sorted(r[0] for r in keys.where(F.col("__k").startswith(prefix)).collect())
            return few[left], left - few.index(few[left])
    return prefix, left


def exact_split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """rows with `split`: exactly int(n * share) of the n rows are `val`, the others `train`. Which ones follows from seed and rows alone. Rows that
    agree in all columns and stand at the border are numbered inside their partitions (see `numbered`), which of them are taken makes no
    difference. A null key is one like any other."""
    keyed = cut(rows.drop("split").withColumn("__k", order_key(rows.drop("split"), F.col(key), seed)))
    wanted = int(keyed.count() * share)
    prefix, rest = threshold(keyed.select("__k"), wanted)
    val = F.col("__k") < F.lit(prefix)
    if not rest:
        return keyed.withColumn("split", F.when(val, "val").otherwise("train")).drop("__k")
    border = numbered(keyed.where(F.col("__k").startswith(prefix)), [], "__n")
    others = keyed.where(~F.col("__k").startswith(prefix)).withColumn("split", F.when(val, "val").otherwise("train"))
    return others.unionByName(border.withColumn("split", F.when(F.col("__n") <= rest, "val").otherwise("train")).drop("__n")).drop("__k")


def numbered(rows: DataFrame, order: list[str], out: str = "id", first: int = 1) -> DataFrame:
    """rows with running numbers in `order`, without gaps: rows are dealt by ranges of the order, counted by partition, and numbered inside each one from
    its offset. Rows that tie are dealt by a hash of the row, so one value of the order may fill many partitions; with no order rows stay where they
    are. What is counted is written first, so that counts and numbers are of the same partitions."""
    tie = F.xxhash64(*[F.col(c) for c in rows.columns if not _is_map(rows, c)])
    dealt = rows.withColumn("__tie", tie)
    dealt = dealt.repartitionByRange(*[F.col(c) for c in order], F.col("__tie")) if order else dealt
    written = cut(dealt.withColumn("__part", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in written.groupBy("__part").agg(F.count(F.lit(1))).collect()}
    offsets, below = [], first - 1
    for part in sorted(counts):
        offsets.append((part, below))
        below += counts[part]
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*[F.col(c) for c in order], "__tie"))
    session = rows.sparkSession
    starts = session.createDataFrame(offsets, "__part int, __start long")
    return written.join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + own).drop("__part", "__start", "__tie")


def _is_map(rows: DataFrame, column: str) -> bool:
    return "map<" in rows.schema[column].dataType.simpleString()


def coco_tables(labels: DataFrame, images: DataFrame, categories: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """COCO's images and annotations with running ids from 1 in the order of document, page and label. images have doc, page, width and height; labels have
    doc, page, ord, label and a box in shares of the page. Labels of unknown kind, and those without an image, are left out and get no id; pages
    without labels keep theirs."""
    shown = numbered(images.select("doc", "page", "width", "height"), ["doc", "page"], "image_id")
    kinds = F.create_map(*[F.lit(x) for kv in sorted(categories.items()) for x in kv])
    known = labels.withColumn("category_id", F.try_element_at(kinds, F.lower("label"))).where("category_id is not null")
    box = g.box()
    known = known.join(shown, ["doc", "page"]).select(
        "image_id", "ord", "category_id", *[(v * F.col(side)).alias(name) for name, v, side in (("x", box.x0, "width"), ("y", box.y0, "height"), ("w", box.width, "width"), ("h", box.height, "height"))],
        F.format_string("%d %.6f %.6f %.6f %.6f", "category_id", box.centre[0], box.centre[1], box.width, box.height).alias("yolo"),
    )
    marked = numbered(known.withColumn("area", F.col("w") * F.col("h")), ["image_id", "ord"], "annotation_id")
    return shown.withColumn("file_name", F.format_string("%s_p%d.jpg", F.col("doc").cast("string"), F.col("page").cast("int"))), marked
