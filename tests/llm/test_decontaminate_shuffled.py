"""Decontamination where the benchmark's windows are too many to be broadcast: same rows, no key that gathers, no null key."""

from pyspark.sql import functions as F

from pagewright.llm import decontaminate

HOT = "one passage that is in every second text of this corpus and in the benchmark too"


def made(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit(HOT + " "), F.col("id").cast("string"))).when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.concat(F.lit("plain words of the text number "), F.col("id").cast("string"), F.lit(" short item "), F.col("id").cast("string"))).alias("text"),
    )
    bench = spark.createDataFrame([(1, HOT), (2, "short item 5"), (3, "short item 77"), (4, None), (5, "words of the text number 9 short item 9 and what follows it here")], "item_id long, text string")
    return docs, bench


def test_same_rows_as_by_broadcast(spark):
    docs, bench = made(spark)
    names = ("id", "md5", "copies", "n_words", "items", "hits")
    rows = lambda how: sorted(map(repr, decontaminate.scan(docs, bench, broadcast_bytes=how).select(*names).collect()))
    one, other = rows(0), rows(decontaminate.BROADCAST_BYTES)
    assert one == other and len(one) == 6000 and sum("items=[1]" in r for r in one) == 3000


def test_no_null_key_and_no_broadcast_of_windows(spark):
    docs, bench = made(spark)
    plan = decontaminate.scan(docs, bench, broadcast_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "Python" not in plan


def test_hot_anchors_are_dealt_out(spark):
    keyed = spark.range(40_000).select(F.col("id"), F.lit("x").alias("md5"), F.col("id").cast("int").alias("at"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("__anchor"))
    probe = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "__anchor long, window int")
    rows, facts = decontaminate.salted(keyed, probe)
    parts = rows.repartition(32, "__anchor", "__salt").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in parts) < 40_000 / 8
    met = rows.join(facts, ["__anchor", "__salt"])
    plain = keyed.join(probe, "__anchor")
    assert met.drop("__salt").select(*plain.columns).exceptAll(plain).count() == 0 and met.count() == plain.count()


def test_the_filter_loses_nothing(spark):
    probe = spark.range(5000).select(F.xxhash64("id").alias("__anchor"))
    keyed = spark.range(200_000).select(F.xxhash64("id").alias("__anchor"), "id")
    kept = decontaminate.in_filter(keyed, probe)
    assert kept.where("id < 5000").count() == 5000 and kept.count() < 5000 + 2000 and kept.columns == ["__anchor", "id"]
