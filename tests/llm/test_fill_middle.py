"""Fill-in-middle: cuts against a plain version, exact restoring, odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagewright.llm import fill_middle

TEXTS = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "x\r\ny\n\nz", "é😀\n\x00z\n" * 7, "has <P> in it\nb", "<S", "<\n<M\n>", "P>\n<P\n>", "one\n" * 3000, "l" * 300_000, " a\x85b\x0bc\nd"]


def plain(doc_id, text, seed=7, rate=100, spm=50, pattern=r"[^\n]*\n|[^\n]+", marks=fill_middle.MARKS):
    text, (p, s, m) = text or "", marks
    units = re.findall(pattern, text, re.S)
    code = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(code[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(pre), len(mid), f"{p}{pre}{s}{suf}{m}{mid}" if form == "psm" else f"{s}{suf}{p}{pre}{m}{mid}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 * k + j, t, "old") for k in range(4) for j, t in enumerate(TEXTS)] + [(None, "a\nb\nc", "old"), (3, TEXTS[3], "old")]
    return spark.createDataFrame(rows, "doc_id long, text string, fim string").withColumn("form", F.lit(1)).withColumn("batch", F.array(F.lit(None).cast("date")))


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 10, "seed": 11}, {"unit": "character"}, {"marks": ("<|pre|>", "{suf}", "[it's mid]")}])
def test_cuts_and_restores(docs, options):
    given = {k: v for k, v in options.items() if k != "unit"} | ({"pattern": "."} if options.get("unit") else {})
    cut = fill_middle.transform(docs, **options)
    assert cut.columns == ["doc_id", "text", "form", "batch", "fim"]
    back = fill_middle.restore(cut.select("doc_id", "text", "fim.*"), **({"marks": options["marks"]} if "marks" in options else {})).collect()
    assert len(back) == 4 * len(TEXTS) + 2
    for r in back:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, **given)
        assert r.restored == (r.text or "")
    assert {r.form for r in back} == {"plain", "spm", "psm"}


def test_every_cut_can_be_undone(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 1 + id % 9), k -> substring('a<b>P\nS\nM<\n', 1 + int((id * 7 + k * k) % 11), 3)), '')").alias("text"))
    back = fill_middle.restore(fill_middle.transform(rows).select("text", "fim.*"))
    assert back.where(F.col("restored") != F.col("text")).count() == 0 and back.groupBy("form").count().count() == 2


def test_empty_table_and_bad_marks(spark, docs):
    none = fill_middle.transform(docs.limit(0))
    assert none.count() == 0 and fill_middle.restore(none.select("fim.*")).count() == 0
    for marks in (("<P>", "<S>"), ("aba", "c", "d"), ("<P", "<P>", "<S>"), ("", "b", "c"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            fill_middle.transform(docs, marks=marks)


def test_parts_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * (1 << 20)] * 10 + [None, ""] + ["y" * (1 << 23)] + ["z"] * 5000})
    sizes = [(p.num_rows, p.column(0).nbytes) for p in fill_middle.bounded(iter([batch]), "text")]
    assert sum(n for n, _ in sizes) == batch.num_rows and max(n for n, _ in sizes) <= fill_middle.PART_ROWS and sizes[0][0] == 4
