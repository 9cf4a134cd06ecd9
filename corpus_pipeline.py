"""The corpus pipeline: language ID, near-dedup, decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; run() writes each one as
Parquet to the shared folder and reads it again for the next. A stage's table is deleted when the next one is written; the
last one is the result's and stays until the caller deletes it (its folder is the common path of inputFiles()).

Nulls in any column, repeated rows, empty tables and extra columns are allowed everywhere; extra columns are dropped.
Each stage's docstring gives the result for them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, langid, mixing, pii, simhash
from pagewright.llm.common import remainder, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language: those whose text is null or has no letter, and all of them where no
    row has a language to learn from. Rows with a null id are judged but not learnt from; repeated rows all stay or go."""
    profiles = langid.fit(docs.where(remainder("doc_id", 5) != 0))
    return langid.predict(docs.select(*COLUMNS), profiles).where(F.col("language.lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, the one with the least id (null ids come last; ties: see keep_one).
    Groups are those of the operator's contract: shingles of four words, fingerprints linked if they differ in at most
    four bits; null and wordless texts are a group. Repeated rows are copies of each other."""
    return simhash.keep_one(docs.select(*COLUMNS), width=4, most=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more are words of benchmark windows. Null and wordless texts stay; repeated
    rows all stay or go."""
    return decontaminate.remove(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what discloses it; n_chars follows the text and is null for a null text. Repeated rows get
    equal texts."""
    return pii.sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources come near their target weights. A null source is a source; of
    equal sizes the order is by a hash of the id, and repeated rows are rows of their own."""
    return mixing.emit(docs.select(*COLUMNS))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", private), ("mix", mix)]

#: SQL can't express the language and PII stages.
ORACLE_SQL = None


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
