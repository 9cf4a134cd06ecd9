"""Fill-in-middle transformation by DuckDB inside mapInArrow.

A text of n units (lines, or code points) is cut in two places into prefix, middle and suffix, and these are put together again
with the middle last, so that a model that reads left to right learns to fill it in. Where a text is cut and which form it
takes follow from the sha256 of `seed:doc_id` alone, so reruns agree whatever the partitioning:

h1 to h4 are the first four groups of 8 hex digits. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the
middle after the larger. A text is left plain if h3 % 100 is not below `rate`; of the others h4 % 100 below `spm` gives the
form spm (suffix, prefix, middle), else psm (prefix, suffix, middle).

Each Arrow batch is registered with an in-memory DuckDB, one for each task and on one thread, part by part (PART_ROWS rows and
about PART_BYTES bytes); its columns pass through, and the SQL's result is added as a struct. No row is handled in Python. Memory
is bounded by a part, and a longer text makes a part of its own.

Defined cases: null and empty texts, and texts that hold one of the marks, stay plain (a null text's output is the empty string);
prefix_chars and middle_chars are null for plain ones. A null id is hashed as an empty one. Equal ids are cut by the same
hashes, so repeated rows get equal results. Empty tables give empty tables; a column that is called like the output is replaced,
all others pass through.

`restore` is the inverse and needs output and form only. It is exact as no mark can begin inside another mark or across its end:
the first character of a mark must occur in no mark but as its first one, and no mark may begin another (others raise ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from pagewright.llm.common import parts_of

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: The pattern of one unit.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "character": r"(?s:.)"}
PART_ROWS, PART_BYTES = 2048, 1 << 22
FIM = "n long, form string, prefix_chars long, middle_chars long, output string"

CUT_SQL = r"""
WITH units AS (
  SELECT coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {unit}) AS u, sha256({seed} || ':' || coalesce(CAST(id AS VARCHAR), '')) AS hex FROM batch
), hashed AS (
  SELECT text, u, len(u) AS n, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2, CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM units
), cuts AS (
  SELECT text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT text, n, form, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS prefix, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS middle,
    coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS suffix
  FROM cuts
)
SELECT CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
FROM parts
"""

#: The first mark is at the start; `second` is the one between the first two parts.
RESTORE_SQL = r"""
WITH places AS (
  SELECT form, output, CASE form WHEN 'psm' THEN {p} ELSE {s} END AS first, CASE form WHEN 'psm' THEN {s} ELSE {p} END AS second FROM batch
), found AS (
  SELECT *, strpos(output, second) AS i, strpos(output, {m}) AS j FROM places
), parts AS (
  SELECT form, output, substring(output, length(first) + 1, i - length(first) - 1) AS one, substring(output, i + length(second), j - i - length(second)) AS two, substring(output, j + length({m})) AS middle FROM found
)
SELECT CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || middle || two WHEN 'spm' THEN two || middle || one END AS restored FROM parts
"""


def check_marks(marks: tuple[str, str, str]) -> None:
    """Raises ValueError unless every place where a mark occurs in an output is one where it was put."""
    if len(marks) != 3 or not all(marks) or any(m[0] in n[1:] for m in marks for n in marks):
        raise ValueError("there must be three marks, and the first character of one must not occur in any but as its first")
    if any(a != b and marks[b].startswith(marks[a]) for a in range(3) for b in range(3)):
        raise ValueError("no mark may begin another one")


def literal(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def bounded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of at most PART_ROWS rows of which all but the last hold less than PART_BYTES bytes of the column."""
    for part in parts_of(batches, PART_ROWS):
        size, begin = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(part.column(column)), 0).to_pylist()):
            size += n
            if size >= PART_BYTES:
                yield part.slice(begin, k + 1 - begin)
                size, begin = 0, k + 1
        if begin < part.num_rows:
            yield part.slice(begin)


def by_duckdb(df: DataFrame, sql: str, columns: dict[str, str], out: str, kind: str) -> DataFrame:
    """df with the column `out` of the type `kind`, computed by SQL that reads `batch`, which has df's columns under the given names, and returns
    a row for each of its rows in their order (a struct if the SQL returns several columns)."""
    rows = df.drop(out)
    field = StructType.fromDDL(kind) if " " in kind else StringType()
    schema = StructType([*rows.schema.fields, StructField(out, field)])
    sources = list(columns.items())

    def work(batches):
        with duckdb.connect(":memory:", config={"threads": 1, "preserve_insertion_order": "true", "autoinstall_known_extensions": "false"}) as db:
            for part in bounded(batches, sources[-1][1]):
                db.register("batch", pa.Table.from_arrays([part.column(source) for _, source in sources], names=[name for name, _ in sources]))
                found = db.sql(sql).to_arrow_table().combine_chunks()
                db.unregister("batch")
                arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in found.columns]
                added = pa.StructArray.from_arrays(arrays, names=found.column_names) if isinstance(field, StructType) else arrays[0]
                yield pa.RecordBatch.from_arrays([*part.columns, added], names=[*part.schema.names, out])

    return rows.mapInArrow(work, schema)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fim", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with the column `out`, a struct of n, form, prefix_chars, middle_chars and output. `rate` and `spm` are per cent."""
    check_marks(marks)
    p, s, m = map(literal, marks)
    sql = CUT_SQL.format(unit=literal(UNITS[unit]), seed=literal(str(seed)), p=p, s=s, m=m, rate=literal(rate), spm=literal(spm))
    return by_duckdb(docs, sql, {"id": id_col, "text": text_col}, out, FIM)


def restore(docs: DataFrame, form_col: str = "form", output_col: str = "output", out: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with the column `out`, the text that `transform` put into output_col (null for a null output or an unknown form)."""
    check_marks(marks)
    p, s, m = map(literal, marks)
    return by_duckdb(docs, RESTORE_SQL.format(p=p, s=s, m=m), {"form": form_col, "output": output_col}, out, "string")
