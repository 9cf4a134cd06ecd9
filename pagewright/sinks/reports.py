"""Reports as JSON and Markdown."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row without its key as a JSON object."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("json"))


def half_even(x: Column, places: int) -> Column:
    """x rounded half to even as the SQL twin does: scaled as a double, so the scaled number decides what a tie is (F.bround asks
    the decimal spelling). The sign of zero stays, and so does a number that overflows when scaled."""
    scaled = x * float(10**places)
    return F.when(F.abs(scaled) < F.lit(float("inf")), F.rint(scaled) / float(10**places)).otherwise(x)


def rounded(rows: DataFrame, places: dict[str, int]) -> DataFrame:
    """rows with some numbers rounded half to even, as reports print them."""
    return rows.withColumns({c: half_even(F.col(c).cast("double"), n) for c, n in places.items()})


def dataset_yaml(sets: DataFrame, names: list[str]) -> DataFrame:
    """(name, yaml): the description of a label set (name, path), its classes in order."""
    classes = "\n".join(f"  {k}: {n}" for k, n in enumerate(names))
    return sets.select("name", F.concat(F.lit("path: "), F.col("path"), F.lit(f"\ntrain: images/train\nval: images/val\nnc: {len(names)}\nnames:\n{classes}\n")).alias("yaml"))


def zip_directory(folder: str, target: str) -> None:
    """A zip file of all files under a local folder, with names relative to it. Runs on the driver."""
    root = Path(folder)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(p for p in root.rglob("*") if p.is_file()):
            z.write(path, path.relative_to(root).as_posix())


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def offenders_markdown(worst: DataFrame) -> DataFrame:
    """One row: a Markdown table of the worst regions, of which there are few."""
    line = F.format_string("| %d | %s | %s | %.3f |", F.col("rank").cast("int"), "doc_id", "label", "score")
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    head = "| Rank | Document | Label | Score |\n| --- | --- | --- | --- |\n"
    return worst.agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")).alias("markdown"))
