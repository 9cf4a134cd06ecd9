"""What queries move and hold grows with their input, however it is dealt into documents."""

import re
import time

import pytest
from pyspark.sql import functions as F

from pagewright import shared
from pagewright.plans import catalogue


def shuffled(spark, rows):
    """Bytes that writing the rows adds to the session's shuffles."""

    def so_far():
        time.sleep(1)  # figures of tasks come in late
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = so_far()
    rows().write.format("noop").mode("overwrite").save()
    return so_far() - before


@pytest.mark.parametrize("name", ["scope_texts", "floating_order", "nested_texts"])
def test_nested_blocks_of_deep_documents(spark, tmp_path, name):
    """One document of 4000 blocks, about 1600 deep, moves no more than eight of 500."""
    size = {}
    for users in (1, 8):
        path = tmp_path / str(users)
        spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % users + 1).alias("user_id")).write.parquet(str(path / "events.parquet"))
        size[users] = shuffled(spark, lambda path=path: catalogue.QUERIES[name](spark, str(path)))
    assert 0 < size[1] < 1.5 * size[8]


@pytest.mark.parametrize("name", ["grid_problems", "tabbed_paragraphs", "grid_rectangles", "publaynet_labels"])
def test_shares_of_tasks_stay(spark, monkeypatch, name):
    """Four times smaller shares are at least three times as many tasks, in the shuffle by which lines are dealt to their tables, paragraphs and images."""
    counts = []
    for bytes_ in (4000, 1000):
        monkeypatch.setattr(shared, "SHARE_BYTES", bytes_)
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        counts.append(max(map(int, re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)), default=0))
    assert counts[1] > 8 and counts[1] >= 3 * counts[0] > 0


@pytest.mark.parametrize("name", ["grid_rectangles", "grid_problems", "tabbed_paragraphs", "publaynet_labels"])
def test_rows_are_dealt_out_unheld(spark, monkeypatch, name):
    """Between 200 and 3200 shares there are 200 tasks, to which rows are written without being held in memory; beyond there are more."""
    counts = []
    for bytes_ in (100, 10):
        monkeypatch.setattr(shared, "SHARE_BYTES", bytes_)
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        counts.append(max(map(int, re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)), default=0))
    assert counts[0] == 200 < counts[1]


def test_classes_do_not_gather_annotations(spark):
    """A join by class would put all annotations of a class into one task."""
    plan = catalogue.QUERIES["publaynet_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(category_id" not in plan


def test_texts_are_cut_into_words_once(spark):
    """Structural pairs cut each text into words before the join, not for each pair."""
    plan = catalogue.QUERIES["structural_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join Inner, ")[0]
    assert "split(" not in joined and "split(" in plan
