"""Lines that spilled onto extra pages: where they stood in the reference and which block they come from."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as t


def page_lines(lines: DataFrame) -> DataFrame:
    """lines with text, cleaned, numbered on their page by height (rounded to a tenth) and x."""
    clean = lines.withColumn("text", t.collapse(t.drop_invisible(F.col("text")))).where(F.col("text") != "")
    return clean.withColumn("line", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.bround("y0", 1), "x0")))


def best_matches(lines: DataFrame, targets: DataFrame, inside: float | None = 0.95, least: float = 0.0) -> DataFrame:
    """lines (doc_id, ord, text) with `best`, the `ord` of the most similar target (doc_id, ord, text) of their document, and
    `score`: 1 if equal, `inside` if one holds the other (None: not looked at), else word Jaccard; of equals the first. Null
    and 0 where no score is above 0; below `least` only the score stays.

    A document's targets pass through one task before its lines, and are held with an index of their words: no pairs leave
    it. Null and blank texts match nothing."""
    ready = lambda side, kind: side.select("doc_id", "ord", F.lit(kind).alias("kind"), t.collapse(F.lower(F.col("text"))).alias("text"))
    rows = ready(targets, 0).unionByName(ready(lines, 1)).repartition("doc_id").sortWithinPartitions("doc_id", "kind", "ord")

    def run(batches):
        of, texts, words, ids, at, first = object(), [], [], [], {}, {}
        for batch in batches:
            out = []
            for doc, ord_, kind, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if doc != of:
                    of, texts, words, ids, at, first = doc, [], [], [], {}, {}
                if kind == 0:
                    if text:
                        own = set(text.split())
                        for w in own:
                            at.setdefault(w, []).append(len(texts))
                        first.setdefault(text, len(texts))
                        texts.append(text)
                        words.append(len(own))
                        ids.append(ord_)
                    continue
                out.append((doc, ord_, *_best(text, texts, words, ids, at, first, inside)))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, [batch.schema.field(0), batch.schema.field(1), batch.schema.field(1), pa.field("score", pa.float64())], strict=True)], names=["doc_id", "ord", "best", "score"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = rows.mapInArrow(run, f"doc_id {kind['doc_id']}, ord {kind['ord']}, best {kind['ord']}, score double")
    return found.withColumn("best", F.when((F.col("score") > 0) & (F.col("score") >= least), F.col("best")))


def _best(text, texts, words, ids, at, first, inside):
    if not text:
        return None, 0.0
    if text in first:
        return ids[first[text]], 1.0
    own, shared = set(text.split()), {}
    for w in own:
        for k in at.get(w, ()):
            shared[k] = shared.get(k, 0) + 1
    best, score = None, 0.0
    if inside is not None:
        k = next((k for k, other in enumerate(texts) if text in other or other in text), None)
        if k is not None:
            best, score = k, inside
    for k in sorted(shared):
        n = shared[k] / (len(own) + words[k] - shared[k])
        if inside is not None and (text in texts[k] or texts[k] in text):
            n = inside
        if n > score or (n == score and best is not None and k < best):
            best, score = k, n
    return (None if best is None else ids[best]), score
