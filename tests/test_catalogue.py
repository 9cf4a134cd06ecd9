"""Every query with an SQL twin gives the twin's rows."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.operators import matching
from pagewright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, twin, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalogue.ORACLE_SQL:
        want = twin.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        keys = sorted(got.columns)
        rows = lambda df: sorted((tuple(None if pd.isna(x) else x for x in r) for r in df[keys].itertuples(index=False, name=None)), key=repr)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_greedy_match_reads_whole_texts(spark, tmp_path):
    """Texts that part only behind a long opening aren't equal, so a box that fits a little better doesn't win."""
    opening = " ".join(f"word{k}" for k in range(60))
    tail = lambda x: " ".join(f"{x}{k}" for k in range(140))
    texts = [f"{opening} {tail('a')}", f"{opening} {tail('b')}", f"other start {tail('c')}", f"quite another opening of a text {tail('c')}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    corners = [[0.0, 0.0, 0.1, 0.1], [0.01, 0.0, 0.09, 0.1], [-0.4, 0.3, 0.1, 0.1], [0.3, -0.4, 0.1, 0.1]]
    spark.createDataFrame([(k, 0, e) for k, e in enumerate(corners)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    side = catalogue._boxes(spark, str(tmp_path)).join(spark.createDataFrame(list(enumerate(texts)), "vec_id long, text string"), "vec_id").withColumn("doc_id", F.lit(0)).withColumn("ord", F.col("vec_id"))
    pairs = {(r.ref_ord, r.gen_ord): r.score for r in matching.vision_candidates(side, side).collect()}
    assert pairs[0, 0] == pytest.approx(1.0) and pairs[0, 1] == pytest.approx(0.4 * 14 / 15 + 0.6 * 60 / 340) and pairs[2, 3] == pytest.approx(0.6 * 140 / 148)
    got = {r.ref_ord: (r.gen_ord, r.score) for r in catalogue.QUERIES["greedy_match"](spark, str(tmp_path)).collect()}
    assert {r: x for r, (x, _) in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_rounded_reports_on_ties(spark, tmp_path):
    """Quotients next to a tie, negative zeros, nulls and numbers that overflow when scaled are rounded as the SQL does."""
    values = [2020.55, 6468.7, -1788.5, -1788.85, 0.35, 1.05, 2.45, 3.15, -0.2, 0.0, -0.35, None, 1e308, -1e308, 9988.03, *(k * 0.35 for k in range(-300, 300)), *(k / 100 for k in range(200000, 203000))]
    spark.createDataFrame([(k, v, 1) for k, v in enumerate(values)], "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    rows = lambda found: sorted((r[0], *map(repr, r[1:])) for r in found)  # noqa: E731  repr tells -0.0 from 0.0
    assert rows(map(tuple, catalogue.QUERIES["rounded_reports"](spark, str(tmp_path)).collect())) == rows(con.execute(catalogue.ORACLE_SQL["rounded_reports"]).fetchall())
