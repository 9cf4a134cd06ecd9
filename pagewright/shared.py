"""The folder that driver and executors share, and cutting lineage with it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (spark.checkpoint.dir). Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagewright-"))
    return sc.getCheckpointDir()


#: Bytes that one task should get, by Spark's estimate (files as they are stored, a few hundred thousand rows of a few numbers), and the estimate from which on there is none.
SHARE_BYTES = 2 << 20
UNKNOWN = 1 << 50
#: How many times larger shares may get for the sake of the tasks that deal them out.
WIDER = 16


def shares(df: DataFrame) -> int | None:
    """Over how many tasks df should be dealt, so that a task's share grows little with df; null where Spark has no estimate of its size.

    Beyond spark.shuffle.sort.bypassMergeThreshold tasks a task that deals rows out holds all that it sends, 1 GB for a split of 9 million rows; up to it, rows go to a file for
    each task and none are held. So that number is passed only by shares of WIDER * SHARE_BYTES."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        return None
    sc = df.sparkSession.sparkContext
    n, unheld = -(-size // SHARE_BYTES), int(sc.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(sc.defaultParallelism, min(n, max(unheld, -(-size // (WIDER * SHARE_BYTES)))))


def dealt(df: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """df dealt out by keys in `shares` of one size (or n). Spark merges a shuffle's partitions up to a number of compressed bytes, which for rows that compress well
    are millions that a task then sorts, once for each window; and sets the number otherwise, whatever the input. Windows and groups over `by` and more columns need no
    further shuffle."""
    n = n or shares(df)
    return df.repartition(n, *by) if n else df.repartition(*by)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs neither recompute it nor need the executors that
    made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
