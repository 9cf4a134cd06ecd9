"""Nested blocks in depth-first order: texts of blocks that hold blocks, and floating blocks wherever they stand.

blocks have doc_id, ord (unique in the document), parent (the ord of the block that holds them; null at the top) and kind. Depths are unbounded, so
no block carries its way up: a walk numbers the blocks of a document, and what is inside a block are the numbers from its own up to its end. Documents are
dealt out over the tasks, each of which holds one document's blocks at a time; rows without doc_id or ord are left out.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagewright.shared import dealt, shares

#: What stands for a table in a text.
TABLE = "TABLE"
#: Characters of texts that are handed on at once.
CHARS = 4_000_000


def _by_document(batches):
    """Arrow tables of whole documents, from batches that are sorted by doc_id, and where each document in them begins and ends."""

    def bounds(docs):
        return [0, *(k for k in range(1, len(docs)) if docs[k] != docs[k - 1]), len(docs)]

    held, of = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        docs = batch.column("doc_id")
        if held and docs[0].as_py() == of and docs[-1].as_py() == of:
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch])
        at = bounds(whole.column("doc_id").to_pylist())
        if len(at) > 2:
            yield whole.slice(0, at[-2]), at[:-1]
        held, of = whole.slice(at[-2]).combine_chunks().to_batches(), docs[-1].as_py()
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, [0, whole.num_rows]


def _walk(ords: list, parents: list) -> tuple[list, list, list, list]:
    """Of one document's blocks, in order of ord: the row of each block's parent (-1 at the top), depth, number in the walk, and the first number behind all that is in it. The
    least block of each circle of parents is at the top."""
    n, row = len(ords), {o: k for k, o in enumerate(ords)}
    up, seen = [row.get(p, -1) if p is not None else -1 for p in parents], [-1] * n
    for k in range(n):
        at = k
        while at >= 0 and seen[at] < 0:
            seen[at] = k
            at = up[at]
        if at >= 0 and seen[at] == k:  # a circle that no block before has led to
            least, other = at, up[at]
            while other != at:
                least, other = min(least, other), up[other]
            up[least] = -1
    inside, todo = {}, []
    for k in range(n - 1, -1, -1):
        (todo if up[k] < 0 else inside.setdefault(up[k], [])).append(k)
    depth, pre, end, walked = [0] * n, [0] * n, [0] * n, []
    while todo:
        k = todo.pop()
        pre[k] = len(walked)
        walked.append(k)
        for c in inside.get(k, ()):
            depth[c] = depth[k] + 1
            todo.append(c)
    for k in reversed(walked):
        end[k] = max(end[k], pre[k] + 1)
        if up[k] >= 0:
            end[up[k]] = max(end[up[k]], end[k])
    return up, depth, pre, end


def _walked(blocks: DataFrame, with_path: bool) -> DataFrame:
    shape = T.StructType([f for f in blocks.schema if f.name not in {"path", "depth", "pre", "end"}])
    names, path = shape.names, [T.StructField("path", T.ArrayType(shape["ord"].dataType))] if with_path else []
    out = T.StructType([*shape, *path, *(T.StructField(c, T.IntegerType()) for c in ("depth", "pre", "end"))])

    def numbered(batches):
        for docs, at in _by_document(batches):
            ords, parents = docs.column("ord").to_pylist(), docs.column("parent").to_pylist()
            held, paths, numbers = [], [], ([], [], [])
            for a, b in zip(at, at[1:], strict=False):
                own = ords[a:b]
                up, *found = _walk(own, parents[a:b])
                held += [own[u] if u >= 0 else None for u in up]
                for column, values in zip(numbers, found, strict=True):
                    column += values
                if with_path:
                    ways = [None] * len(own)
                    for k in sorted(range(len(own)), key=found[1].__getitem__):
                        ways[k] = [*(ways[up[k]] if up[k] >= 0 else ()), own[k]]
                    paths += ways
            columns = [docs.column(c) if c != "parent" else pa.array(held, docs.schema.field(c).type) for c in names]
            columns += [pa.array(paths, pa.list_(docs.schema.field("ord").type))] if with_path else []
            yield from pa.table([*columns, *(pa.array(c, pa.int32()) for c in numbers)], names=out.names).to_batches(max_chunksize=10_000)

    known = blocks.where("doc_id is not null and ord is not null").select(*names)
    return dealt(known, "doc_id").sortWithinPartitions("doc_id", "ord").mapInArrow(numbered, out)


def walk(blocks: DataFrame) -> DataFrame:
    """blocks with `depth` from 0, `pre`, the number from 0 in a depth-first walk of the document, and `end`: what is inside a block has the numbers from its `pre` to
    before its `end`. `parent` then always leads to a top: it is null where the parent isn't in the document, and for the least block of each circle of parents."""
    return _walked(blocks, False)


def paths(blocks: DataFrame) -> DataFrame:
    """The same with `path`, the ords from the top to the block itself. All paths of a document grow with its blocks times its depth, so nothing here reads them."""
    return _walked(blocks, True)


def block_texts(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, ord and text of all blocks with own text: the spans of each block in order, stripped."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "")
    own = spans.groupBy("doc_id", F.col("block").alias("__block")).agg(text.alias("__text")).withColumnRenamed("__block", "ord")
    return blocks.select("doc_id", "ord").join(own, ["doc_id", "ord"]).withColumn("text", F.regexp_replace("__text", r"(?U)^\s+|\s+$", "")).drop("__text")


def nested_texts(walked: DataFrame, texts: DataFrame, kinds: tuple[str, ...], sep: str = " ", table: str | None = TABLE, scope: Column | None = None) -> DataFrame:
    """doc_id, ord, depth, text of each block of one of `kinds`: its own text and those of all blocks in it, whatever their depth, in depth-first order, the
    empty ones left out, parted by `sep`. A table inside gives the word `table` and what it holds isn't read; null reads tables as other
    blocks.
    `scope` says which blocks count at all. walked is the result of `walk` or `paths`.

    What a block reads has the same innermost table above it as the block itself, so it is one slice of that table's texts.

    The four forms: a block's text (" ", TABLE), a document's lines (see `document_text`), a row's text (kinds of cells, table=None), and that of one of the
    scopes header, body and footer."""
    rows = walked.where(scope) if scope is not None else walked
    rows = rows.select("doc_id", "ord", "depth", "pre", "end", F.col("kind").isin(*kinds).alias("holds"), (F.col("kind") == "table").alias("is_table"))
    said = rows.join(texts.select("doc_id", "ord", "text"), ["doc_id", "ord"], "left")
    if table is not None:
        said = said.withColumn("text", F.when(F.col("is_table"), F.lit(table)).otherwise(F.col("text")))
    said = said.where(F.col("holds") | F.col("is_table") | (F.coalesce("text", F.lit("")) != ""))
    shape = said.schema
    out = T.StructType([shape["doc_id"], shape["ord"], shape["depth"], T.StructField("text", T.StringType())])

    def slices(pre, end, holds, is_table, text):
        """(row, text) of each block that holds others."""
        own, groups = [], [([], [])]  # of each row, the numbers and texts below the same innermost table
        above = [(float("inf"), 0)]  # ends of the tables around, and their groups
        for k, at in enumerate(pre):
            while above[-1][0] <= at:
                above.pop()
            own.append(above[-1][1])
            if text[k]:
                numbers, words = groups[own[k]]
                numbers.append(at)
                words.append(text[k])
            if table is not None and is_table[k]:
                above.append((end[k], len(groups)))
                groups.append(([], []))
        for k, at in enumerate(pre):
            if holds[k]:
                numbers, words = groups[own[k]]
                upto = at + 1 if table is not None and is_table[k] else end[k]
                yield k, sep.join(words[bisect_left(numbers, at) : bisect_left(numbers, upto)])

    def joined(batches):
        def handed(docs, keep, found):
            return pa.RecordBatch.from_arrays([*docs.select(out.names[:3]).take(pa.array(keep, pa.int64())).combine_chunks().to_batches()[0].columns, pa.array(found, pa.string())], names=out.names)

        for docs, at in _by_document(batches):
            columns = [docs.column(c).to_pylist() for c in ("pre", "end", "holds", "is_table", "text")]
            keep, found, chars = [], [], 0
            for a, b in zip(at, at[1:], strict=False):
                for k, text in slices(*(c[a:b] for c in columns)):
                    keep.append(a + k)
                    found.append(text)
                    chars += len(text)
                    if chars > CHARS:
                        yield handed(docs, keep, found)
                        keep, found, chars = [], [], 0
            if keep:
                yield handed(docs, keep, found)

    return dealt(said, "doc_id", n=shares(walked)).sortWithinPartitions("doc_id", "pre").mapInArrow(joined, out)


def document_text(walked: DataFrame, texts: DataFrame, deep: bool = False) -> DataFrame:
    """doc_id and text: one line for each block at the top that has a text (deep: for each block at any depth)."""
    rows = (walked if deep else walked.where("depth = 0")).select("doc_id", "ord", "pre").join(texts.select("doc_id", "ord", "text"), ["doc_id", "ord"]).where("text <> ''")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: s["text"]), "\n").alias("text"))


def floating(walked: DataFrame, elements: DataFrame) -> DataFrame:
    """The floating ones of `elements` (doc_id, ord, block, floating and others) with `place`, from 1 in each document: header blocks count after the body's, in depth-first
    order, an element after the block that holds it, footers not at all. A block inside a text box goes with the box, so elements there aren't listed."""
    # a block is in a box if one that began before or with it ends behind it
    boxed = F.max(F.when(F.col("kind") == "textbox", F.col("end"))).over(Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))
    held = walked.select("doc_id", F.col("ord").alias("block"), F.col("scope").alias("in_scope"), F.col("pre").alias("__at"), (F.coalesce(boxed, F.lit(0)) > F.col("pre")).alias("__boxed"))
    found = elements.where("floating").join(held.where("not __boxed and (in_scope is null or in_scope <> 'footer')"), ["doc_id", "block"]).drop("__boxed")
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("in_scope") == "header", 1).otherwise(0), "__at", "ord")
    return found.withColumn("place", F.row_number().over(order)).drop("__at")
