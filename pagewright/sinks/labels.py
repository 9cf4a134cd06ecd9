"""Label files: YOLO lines and COCO JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import geometry as g


def yolo_files(boxes: DataFrame) -> DataFrame:
    """(file_name, content): each image's label lines in order; boxes wholly off the page are left out."""
    line = g.yolo_line(F.col("class_id"), F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    rows = boxes.withColumn("line", line)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("ord", "line")))), lambda s: s["line"]), "\n")
    return rows.groupBy("file_name").agg(joined.alias("content"))


def coco(images: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """COCO tables: images with running ids and annotations in pixels. Ids are a hash of the name, so no order over all
    images is needed; within an image annotations are numbered."""
    keyed = images.withColumn("id", F.abs(F.xxhash64("file_name")))
    x, y, w, h = g.box_to_coco(g.box(), F.col("width"), F.col("height"))
    rows = boxes.join(keyed, "file_name").withColumn("k", F.row_number().over(Window.partitionBy("file_name").orderBy("ord")))
    return keyed, rows.select(F.abs(F.xxhash64("file_name", "k")).alias("id"), F.col("id").alias("image_id"), "category_id", F.array(x, y, w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))
