"""Layout scanners as plug-ins: each turns files into regions of one form, and a filter on document or page skips files.

A scanner is a function from (spark, path) to a table with file_name, ord, label and a box in shares of the page; `scanner` registers it under a name, `scan`
applies it. A page's document and number come from its file's name (`stem_p3.txt`; without a number it is page 0), which is Spark's file metadata, so
a filter on doc or page is settled when files are listed: the others are never opened. Columns that aren't asked for aren't
made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCANNERS: dict[str, Callable[..., DataFrame]] = {}
#: What a file's name says: everything up to `_p` and digits is the document.
NAME = r"^(.*?)(?:_p(\d+))?\.[^.]*$"
REGIONS = ("doc", "page", "ord", "label", "confidence", "x0", "y0", "x1", "y1", "source")


def scanner(name: str):
    """Registers a scanner. A name that is taken raises ValueError."""

    def add(f):
        if name in SCANNERS:
            raise ValueError(f"there is a scanner {name}")
        SCANNERS[name] = f
        return f

    return add


def scan(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """doc, page, ord, label, confidence (null: not told), x0, y0, x1, y1 and source of the regions in the files under a path."""
    if name not in SCANNERS:
        raise ValueError(f"no scanner {name}; there are {', '.join(sorted(SCANNERS))}")
    found = SCANNERS[name](spark, path, **options)
    if "confidence" not in found.columns:
        found = found.withColumn("confidence", F.lit(None).cast("double"))
    doc, page = F.regexp_extract("file_name", NAME, 1), F.coalesce(F.expr(f"try_cast(regexp_extract(file_name, r'{NAME}', 2) as int)"), F.lit(0))
    return found.withColumn("doc", doc).withColumn("page", page).withColumn("source", F.lit(name)).select(*REGIONS)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """file_name and value of each file; files of labels are small, a page each."""
    return spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_name").alias("file_name"), "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file_name, ord (the line's place in its file, from 0) and the fields of each line."""
    rows = _whole(spark, path).select("file_name", F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    return rows.select("file_name", F.col("ord").cast("long").alias("ord"), F.split(F.trim("line"), r"\s+").alias("f"))


def _number(k: int) -> Column:
    return F.expr(f"try_cast(try_element_at(f, {k + 1}) as double)")


@scanner("yolo")
def yolo(spark: SparkSession, path: str, names: dict[int, str] | None = None) -> DataFrame:
    """Class, box in centre form and, where there is a sixth field, confidence. Lines with fewer than five fields or without numbers are skipped."""
    rows = _lines(spark, path).where(F.size("f") >= 5)
    kind = F.expr("try_cast(f[0] as int)")
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]), kind), kind.cast("string")) if names else kind.cast("string")
    cx, cy, w, h = (_number(k) for k in range(1, 5))
    return rows.select("file_name", "ord", label.alias("label"), (cx - w / 2).alias("x0"), (cy - h / 2).alias("y0"), (cx + w / 2).alias("x1"), (cy + h / 2).alias("y1"), _number(5).alias("confidence")).dropna(subset=["label", "x0", "y0", "x1", "y1"])


@scanner("docbank")
def docbank(spark: SparkSession, path: str) -> DataFrame:
    """Tokens: ten fields at least, the second to fifth are a box in thousandths, the last is the label."""
    rows = _lines(spark, path).where(F.size("f") >= 10)
    return rows.select("file_name", "ord", F.element_at("f", -1).alias("label"), *[(_number(k) / 1000).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"), 1)]).dropna(subset=["x0", "y0", "x1", "y1"])


@scanner("answers")
def answers(spark: SparkSession, path: str) -> DataFrame:
    """A model's answers, one JSON file a page: an array of label and box ([ymin, xmin, ymax, xmax] in thousandths), with or without confidence. Regions without four
    numbers are skipped, and files that aren't such an array."""
    told = _whole(spark, path).select("file_name", F.from_json("value", "array<struct<label:string,box:array<double>,confidence:double>>").alias("r"))
    each = told.select("file_name", F.posexplode("r").alias("ord", "r")).where(F.size("r.box") == 4)
    y0, x0, y1, x1 = (F.col("r.box")[k] / 1000 for k in range(4))
    return each.select("file_name", F.col("ord").cast("long").alias("ord"), F.coalesce("r.label", F.lit("text")).alias("label"), "r.confidence", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).dropna(subset=["x0", "y0", "x1", "y1"])
