"""Labelled page images: COCO, DocBank and YOLO files, and model answers as JSON in text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import geometry as g

COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>>>"


def read_coco(spark: SparkSession, path: str, classes: DataFrame, limit: int | None = None) -> DataFrame:
    """(file_name, class_id, cx, cy, w, h) of each annotation of a mapped category, and a row without class for each image
    without one. limit: of the images. classes: category_id, class_id."""
    whole = spark.read.schema(COCO).json(path, multiLine=True)
    images = whole.select(F.inline("images")).select(F.col("id").alias("image_id"), "file_name", "width", "height")
    if limit is not None:
        images = images.orderBy("image_id").limit(limit)
    found = whole.select(F.inline("annotations")).select("image_id", "category_id", "bbox").join(F.broadcast(classes), "category_id")
    cx, cy, w, h = g.coco_to_centre(*[F.col("bbox")[k] for k in range(4)], F.col("width"), F.col("height"))
    return images.join(found, "image_id", "left").select("file_name", "class_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def publaynet(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """(file_name, class_id, cx, cy, w, h) of samples (file_name, width, height, annotations: array of category_id and bbox in pixels).
    Annotations without box or of an unmapped category are dropped, and samples that none is left of."""
    found = samples.select("file_name", "width", "height", F.inline("annotations")).where((F.size("bbox") == 4) & F.col("category_id").isNotNull()).join(F.broadcast(classes), "category_id")
    cx, cy, w, h = g.coco_to_centre(*[F.col("bbox")[k] for k in range(4)], F.col("width"), F.col("height"))
    return found.select("file_name", "class_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def read_publaynet(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    """The same from JSON lines."""
    return publaynet(spark.read.schema("file_name string, width int, height int, annotations array<struct<category_id:int,bbox:array<double>>>").json(path), classes)


def read_docbank(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of DocBank files: at least ten fields, the second to fifth are a box in thousandths, the last is the label."""
    rows = spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("doc_id"), F.monotonically_increasing_id().alias("ord"), F.split(F.trim("value"), r"\s+").alias("f"))
    number = lambda k: (F.expr(f"try_cast(f[{k}] as double)") / 1000).alias(("x0", "y0", "x1", "y1")[k - 1])
    return rows.where(F.size("f") >= 10).select("doc_id", "ord", F.col("f")[0].alias("token"), *[number(k) for k in range(1, 5)], F.element_at("f", -1).alias("label")).dropna(subset=["x0", "y0", "x1", "y1"])


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """Label lines: class and box in centre form; blank and short lines are skipped."""
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("stem"), F.split(F.trim("value"), r"\s+").alias("f"))
    return rows.where(F.size("f") >= 5).select("stem", F.col("f")[0].cast("int").alias("class_id"), *[F.col("f")[k].cast("double").alias(n) for k, n in enumerate(("cx", "cy", "w", "h"), 1)])


@F.pandas_udf(T.StringType())
def first_json(texts: pd.Series) -> pd.Series:
    """The first JSON object that can be decoded from a text, as JSON; null if there is none."""

    def find(text):
        at = text.find("{") if text else -1
        while at >= 0:
            try:
                return json.dumps(json.JSONDecoder().raw_decode(text[at:])[0])
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(find)


def widest_json(text: Column) -> Column:
    """What stands from the first to the last brace, if it is JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def unfenced(text: Column) -> Column:
    """A text without a code fence around it."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```\w*\s*\n?|\n?\s*```\s*$", ""))


def answer_scores(answers: DataFrame, by: list[str]) -> DataFrame:
    """Shares of valid and right answers; answers: expected and predicted doc_type and layout_style, json_valid."""
    share = lambda c, name: F.bround(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 3).alias(name)
    kind, style = F.col("doc_type") == F.col("expected_doc_type"), F.col("layout_style") == F.col("expected_layout_style")
    return answers.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col("json_valid"), "json_valid"), share(kind, "doc_type"), share(style, "layout_style"), share(kind & style, "strict"))
