"""What the corpus operators share: reading, cutting lineage, bounded Arrow batches, stable samples."""

from __future__ import annotations

import contextlib
import ctypes
import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.shared import cut, shared_folder

__all__ = ["by_parts", "cut", "hot_join", "labelled_sample", "one_blas_thread", "one_label", "parts_of", "remainder", "shared_folder", "spread", "stable_sample", "table"]

#: Rows a kernel works on, and returns, at once. Arrow batches themselves are bounded by Spark in bytes
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set).
PART_ROWS = 256
#: A table of more bytes, by Spark's estimate, is never dealt out anew for the sake of idle cores.
SPREAD_BYTES = 1 << 30
#: Distinct values of a sample's key whose counts are broadcast; beyond it they are joined by a shuffle.
BROADCAST_VALUES = 100_000
#: A key is hot if it has more than one in HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot ones.
HOT_SHARE, HOT_LEAST = 1024, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if it is small (SPREAD_BYTES at most) and its scan gives fewer partitions than there are cores:
    a table of one small file would keep the others idle. Larger tables are left alone, whatever the cluster's size."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into parts of at most `rows` rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def by_parts(work, rows: int = PART_ROWS):
    """work(column, ...) as the body of an iterator UDF that passes its results on part by part."""

    def run(batches):
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            for a in range(0, len(columns[0]), rows):
                yield work(*(c.iloc[a : a + rows] for c in columns))

    return run


@contextlib.contextmanager
def one_blas_thread():
    """Keeps numpy's OpenBLAS to one thread: Spark runs a task on each core, so more threads only wait for each other.
    Does nothing where numpy has another BLAS."""
    calls = []
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for prefix, suffix in (("scipy_openblas", "64_"), ("openblas", "64_"), ("openblas", "")):
            put, got = (getattr(library, f"{prefix}_{verb}_num_threads{suffix}", None) for verb in ("set", "get"))
            if put is not None and got is not None:
                calls.append((put, got()))
                put(1)
                break
    try:
        yield
    finally:
        for put, before in calls:
            put(before)


def remainder(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % k


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, label: one row for each id with a non-null 0/1 label; of contradicting rows the larger label counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy("doc_id").agg(F.max(F.col(name).cast("int")).alias("label"))


def stable_sample(rows: DataFrame, by: str, most: int, most_bytes: int, size: Column, seed: int, weight: str | None = None) -> DataFrame:
    """About `most` rows for each value of `by`, of about `most_bytes` bytes by `size` (all rows where there are fewer), drawn by a
    hash of doc_id, so that every run draws the same. Both bounds pick rows and never cut one. The counts per value are aggregated
    first; no group is gathered in one task. They are broadcast if they are few, else joined by a shuffle. The column
    `weight`, if asked for, says how many rows a drawn one stands for."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.coalesce(size, F.lit(0)).cast("double")).alias("__bytes"))
    rate = F.least(F.lit(1.0), F.lit(float(most)) / F.col("__n"), F.lit(float(most_bytes)) / F.greatest("__bytes", F.lit(1.0)))
    counts = counts.select(by, rate.alias("__rate"))
    few = counts.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.join(F.broadcast(counts) if few else counts, by).where(share < F.col("__rate"))
    return (drawn.withColumn(weight, 1 / F.col("__rate")) if weight else drawn).drop("__rate")


def labelled_sample(docs: DataFrame, labels: DataFrame, name: str, modulus: int, held_out: int, most: int, most_bytes: int, seed: int) -> DataFrame:
    """docs' rows of a stable sample of about `most` labelled documents and `most_bytes` bytes for each label, without those whose
    remainder is `held_out`, with `label` and `weight`. The sample's ids are bounded by `most`, so they are broadcast to the
    documents."""
    known = one_label(labels, name).where(remainder("doc_id", modulus) != held_out)
    sizes = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("__size"))
    known = known.join(sizes, "doc_id")
    ids = stable_sample(known, "label", most, most_bytes, F.col("__size"), seed, weight="weight").drop("__size").withColumnRenamed("doc_id", "__id")
    return docs.join(F.broadcast(ids), docs["doc_id"] == F.col("__id")).drop("__id")


def hot_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined to facts, which has one row a key. Keys with more than one in HOT_SHARE of the rows, and more than HOT_LEAST, so
    fewer than HOT_SHARE keys, are joined by a broadcast of their facts, all others by a shuffle; no key's rows gather in one
    task. rows is read twice, so it should be a written table."""
    least = max(HOT_LEAST, rows.count() / HOT_SHARE)
    hot = [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select(key).collect()]
    if not hot:
        return rows.join(facts, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(facts.where(is_hot)), key).unionByName(rows.where(~is_hot).join(facts.where(~is_hot), key))
