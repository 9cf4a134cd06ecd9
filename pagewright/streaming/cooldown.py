"""Per-key state: a cooldown limiter and usage counts, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accepted(events: DataFrame, key: str, ts: str, id_col: str, seconds: int) -> DataFrame:
    """(key, id, micros) of the events that pass: the first of each key and every one at least `seconds` after the last that
    passed. Rejected events don't count as the last; of equal times the least id comes first, and events without a time are
    left out. A fold over each key's events in order, which holds one time, however many events a key has."""
    micros = F.unix_micros(F.col(ts).cast("timestamp")).alias("micros")
    ordered = events.select(key, F.col(id_col).cast("long").alias(id_col), micros).where("micros is not null").repartition(key).sortWithinPartitions(key, "micros", id_col)
    limit = seconds * 1_000_000

    def run(batches):
        of, last = object(), 0
        for batch in batches:
            keep = []
            for k, (who, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if who != of or t - last >= limit:
                    of, last = who, t
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return ordered.mapInArrow(run, ordered.schema)


def retry_after(now: Column, last: Column, seconds: int) -> Column:
    """Whole seconds until the next event passes, 1 at least; 0 if it passes now."""
    left = seconds - (now - last)
    return F.when(last.isNull() | (left <= 0), 0).otherwise(F.greatest(F.lit(1), F.ceil(left))).cast("long")


def accepted_stream(events: DataFrame, key: str, ts: str, id_col: str, seconds: int) -> DataFrame:
    """The same over a stream with a watermark on `ts`: one long of state per key, dropped after its cooldown."""
    limit = seconds * 1_000_000

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["micros", id_col])
        kept = []
        for t, i in zip(rows["micros"], rows[id_col], strict=True):
            if last is None or t - last >= limit:
                last = int(t)
                kept.append((k[0], i, t))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=[key, id_col, "micros"])

    rows = events.select(key, id_col, ts, F.unix_micros(ts).alias("micros"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, {id_col} long, micros long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def client_key(forwarded: Column, real_ip: Column, host: Column) -> Column:
    """The first forwarded address, else the real one, else the host."""
    first = F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit(""))
    return F.coalesce(first, F.nullif(F.trim(real_ip), F.lit("")), F.nullif(host, F.lit("")), F.lit("unknown"))


def usage(events: DataFrame) -> DataFrame:
    """Visitors and conversions by event type."""
    return events.groupBy("event_type").agg(F.count_distinct("user_id").alias("visitors"), F.count(F.lit(1)).alias("conversions"))


def usage_stream(events: DataFrame) -> DataFrame:
    """Running visitors (approximate) and conversions by event type."""
    return events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("visitors"), F.count(F.lit(1)).alias("conversions"))


def running_usage(events: DataFrame, id_col: str = "event_id", ts: str = "ts") -> DataFrame:
    """events' id, event_type and, up to and with each event, `visitors` (different users, exact) and `conversions`, in the order of time and id. A user counts
    where they first occur. Events are counted by type and day first: no task sees more than one day of one type, or more than one row a day of one
    type. A null user counts for no visitor; events without a time come first."""
    day = F.coalesce(F.date_trunc("day", ts), F.lit("0001-01-01").cast("timestamp"))
    rows = events.select(id_col, "event_type", "user_id", F.col(ts).alias("__ts"), day.alias("__day"))
    order = F.struct("__ts", id_col)
    first = rows.where("user_id is not null").groupBy("event_type", "user_id").agg(F.min(order).alias("__first"))
    first = first.select("event_type", F.col(f"__first.{id_col}").alias(id_col), F.lit(1).alias("__new"))
    # a user's first event has one user, so it is new for one
    rows = rows.join(first, ["event_type", id_col], "left").withColumn("__new", F.coalesce("__new", F.lit(0)))
    days = rows.groupBy("event_type", "__day").agg(F.sum("__new").alias("__v"), F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("event_type").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("event_type", "__day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__v", "__c")])
    inside = Window.partitionBy("event_type", "__day").orderBy("__ts", id_col).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("__v", F.sum("__new").over(inside)).withColumn("__c", F.count(F.lit(1)).over(inside)).join(days, ["event_type", "__day"])
    return counted.select(id_col, "event_type", (F.col("__v") + F.col("__v0")).alias("visitors"), (F.col("__c") + F.col("__c0")).alias("conversions"))


def usage_sketches(events: DataFrame, width: str = "1 day", ts: str = "ts", lg: int = 12) -> DataFrame:
    """event_type, start, a sketch of the users and the number of conversions of each window of time; in batch, and as a stream with a
    watermark in append mode. Sketches are a few KB, whatever they count, and can be merged."""
    by = events.groupBy("event_type", F.window(ts, width).alias("w"))
    return by.agg(F.hll_sketch_agg(F.col("user_id"), lg).alias("sketch"), F.count(F.lit(1)).alias("conversions")).select("event_type", F.col("w.start").alias("start"), "sketch", "conversions")


def running_sketches(sketches: DataFrame) -> DataFrame:
    """event_type, start, visitors (estimated) and conversions up to and with each window, from stored sketches; windows that came in several parts are merged.
    The error is that of one sketch (1.6 % is one standard deviation at lg = 12), it doesn't add up."""
    whole = sketches.groupBy("event_type", "start").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("conversions").alias("conversions"))
    upto = Window.partitionBy("event_type").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return whole.select("event_type", "start", F.hll_sketch_estimate(F.hll_union_agg("sketch").over(upto)).alias("visitors"), F.sum("conversions").over(upto).alias("conversions"))
