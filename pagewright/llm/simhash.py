"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint has 64 bits, each set if over half of the hashes of the text's word shingles have it. Fingerprints
are linked if they differ in at most `most` bits, and a document's class is its component of linked fingerprints.

Search. A fingerprint is cut into 32 segments of two bits and mapped to the vector of the segments' bit counts.
The Manhattan distance of two vectors is a lower bound of the number of differing bits, so only vectors within
`most` of each other matter. The segments are dealt into `most` + k bands: vectors within `most` agree wholly on
at least k bands, so each choice of k bands is a grid whose unit cells hold every pair that is in range.
Within a cell, the bound is checked first and the exact distance after it.

Cost. Equal fingerprints are merged before the search. k follows their number, so that a cell stays small: 3 up to some
ten million, more beyond. The fingerprints of cells of more than CELL members, and these only, are dealt into finer grids (a
pair in range shares a cell of any k), up to k = FINEST; a cell that is still larger there is cut into blocks by a
hash and its pairs of blocks are dealt to separate tasks, so no task holds an unbounded cell. What leaves
a task are the edges of a spanning forest over all its links, at most one per fingerprint, never the pairs; a pair
of one task may also be missing where the forest joins its ends, so components are exact and pairs aren't listed.
Components are found by alternating large-star and small-star steps on tables that are cut to the shared folder.

Defined cases: a null, empty or white text has fingerprint zero and is linked like any other. Texts of fewer words
than a shingle hash whole. Texts of any length are read whole. Repeated rows keep one result each; an empty table gives an empty result. A class whose ids are all null has a null
component_id. Other columns pass through `classes`; its own output columns replace ones of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import by_parts, cut, hot_join

SEED = 42
SEGMENTS, SEGMENT_BITS = 32, 2
#: A cell with more fingerprints goes into finer grids, in the end into pairs of blocks of about this size.
CELL = 8192
#: The least and the most bands on which a grid's cells agree, the step to a finer grid, and the members a cell has on
#: average at most where fingerprints are spread evenly.
COARSEST, FINEST, FINER, MEMBERS = 3, 8, 2, 8
#: Cells of up to so many members are compared pair by pair; rows that are looked at together.
SMALL, TOGETHER = 8, 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text's shingles of `width` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1).tolist()
    last = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last))  # noqa: B905  one start for each end
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = 4) -> DataFrame:
    """docs with `__fp`, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from by_parts(lambda part: pd.Series(np.fromiter((fingerprint(t, width) for t in part), np.uint64, len(part)).view(np.int64)))(texts)

    return docs.withColumn("__fp", fp(F.col(text_col)))


def bands_for(n: int, most: int) -> int:
    """On how many bands the cells of n fingerprints agree. A segment's count is 0, 1 or 2 with one, two and one quarter, so
    it carries one and a half bits."""
    fits = (k for k in range(COARSEST, FINEST) if n <= MEMBERS * 2 ** (1.5 * SEGMENTS * k / (most + k)))
    return next(fits, FINEST)


def _cells(fps: DataFrame, most: int, agree: int) -> DataFrame:
    """(fp, key): the cells of all grids, as hashes of (grid, popcount vector on `agree` bands). The grids, up to 495 of them, are a
    literal array, not an expression each: these would neither fit a method's 64 KB nor, in several plans, a driver's heap."""
    bands = most + agree
    fp = F.col("fp")
    low, next_bit = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    counts = fp.bitwiseOR(next_bit).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(low), 1))  # as in embed()
    masks = []
    for b in range(bands):
        mine = range(b * SEGMENTS // bands, (b + 1) * SEGMENTS // bands)
        masks.append(sum(3 << (SEGMENT_BITS * i) for i in mine))
    grids = [sum(masks[b] for b in chosen) for chosen in combinations(range(bands), agree)]
    signed = [g - (1 << 64) if g >> 63 else g for g in grids]
    each = fps.select("fp", counts.alias("counts")).select("fp", "counts", F.posexplode(F.array(*map(F.lit, signed))).alias("grid", "mask"))
    return each.select("fp", F.xxhash64("grid", F.col("counts").bitwiseAND(F.col("mask"))).alias("key"))


def embed(fps: np.ndarray) -> np.ndarray:
    """The popcount vector of each fingerprint, its counts 0, 1, 2 written as 00, 01, 11, so that the Manhattan
    distance of two vectors is the number of bits in which these differ."""
    low, one = np.uint64(0x5555555555555555), np.uint64(1)
    return ((fps | fps >> one) & low) | ((fps & fps >> one & low) << one)


def linked(fps: np.ndarray, codes: np.ndarray, fp: np.ndarray, code: np.ndarray, most: int) -> np.ndarray:
    """Which fingerprints differ in at most `most` bits: the lower bound first, then exactly."""
    near = np.bitwise_count(codes ^ code) <= most
    if near.any():
        near &= np.bitwise_count(fps ^ fp) <= most
    return near


class Forest:
    """Union-find over fingerprints that keeps the links it needed."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def join_cell(fps: np.ndarray, most: int, forest: Forest) -> None:
    """Joins the linked fingerprints of one cell. Each is compared to those not reached yet, so a dense group costs
    little more than its size."""
    codes = embed(fps)
    while len(fps) > 1:
        queue = [(fps[0], codes[0])]
        fps, codes = fps[1:], codes[1:]
        while queue and len(fps):
            fp, code = queue.pop()
            near = linked(fps, codes, fp, code, most)
            if near.any():
                for x, y in zip(fps[near], codes[near], strict=True):
                    forest.join(int(fp), int(x))
                    queue.append((x, y))
                fps, codes = fps[~near], codes[~near]


def forest_of(cells: DataFrame, most: int) -> DataFrame:
    """(a, b): spanning links of the fingerprints `fp` that share a `key`: a cell, or a pair of blocks of one."""

    def run(batches):
        forest = Forest()
        held: list[tuple] = []  # rows that wait; the last cell may go on in the next batch

        def take(key: np.ndarray, fps: np.ndarray) -> None:
            if not len(key):
                return
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            cell = np.repeat(np.arange(len(start)), size)
            codes = embed(fps)
            for step in range(1, SMALL):  # cells of up to SMALL members, all at once
                at = np.flatnonzero((cell[step:] == cell[:-step]) & (size[cell[step:]] <= SMALL)) if len(cell) > step else np.zeros(0, int)
                near = linked(fps[at], codes[at], fps[at + step], codes[at + step], most)
                for p, q in zip(fps[at[near]].tolist(), fps[at[near] + step].tolist(), strict=True):
                    forest.join(p, q)
            for k in np.flatnonzero(size > SMALL):
                join_cell(fps[start[k] : start[k] + size[k]], most, forest)

        waiting = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            waiting += batch.num_rows
            if waiting >= TOGETHER:
                key, fps = (np.concatenate(c) for c in zip(*held, strict=True))
                last = int(np.searchsorted(key, key[-1]))
                if last:
                    take(key[:last], fps[:last])
                held, waiting = [(key[last:], fps[last:])], 0
        if held:
            take(*(np.concatenate(c) for c in zip(*held, strict=True)))
        ends = [(x, forest.root(x)) for x in forest.up]
        ends = [(a, b) for a, b in ends if a != b]
        if ends:
            flat = np.array(ends, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 1]), pa.array(flat[:, 0])], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` with the same components as all links of at most `most` bits."""
    agree, found = bands_for(fps.count(), most), []
    while True:
        cells = _cells(fps, most, agree)
        large = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
        if not large.limit(1).count():
            found.append(forest_of(_dealt(cells), most))
            break
        large = cut(large)
        if agree >= FINEST:
            n = F.ceil(F.col("n") / CELL).cast("int")
            met = cells.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), n).cast("int"))
            met = met.withColumn("other", F.explode_outer(F.sequence(F.lit(0), n - 1)))
            pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
            found.append(forest_of(_dealt(met.select(F.when(F.col("n").isNull(), F.col("key")).otherwise(pair).alias("key"), "fp")), most))
            break
        # small cells are done with; the members of large ones, and no others, meet in finer grids
        found.append(forest_of(_dealt(cells.join(large, "key", "left_anti")), most))
        fps = cut(cells.join(large, "key").select("fp").distinct())
        agree = min(FINEST, max(agree + FINER, bands_for(fps.count(), most)))
    return reduce(DataFrame.unionAll, found).distinct()


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.select("key", "fp").repartition("key").sortWithinPartitions("key")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes with an edge (a, b). Large-star and
    small-star steps alternate until nothing changes; each step's table is cut to the shared folder."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, before = cut(edges), None
    while True:
        wide = both(edges)
        least = wide.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = hot_join(wide, least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # each b has few a left, at most one for each neighbour, so no b is hot
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array_distinct(F.array("a", "b"))).alias("b")).where("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now


def _rooted(docs: DataFrame, id_col: str, text_col: str, width: int, most: int, kept: list[str]) -> DataFrame:
    """The columns `kept` of each row with `__fp`, the class's `__root` (its least fingerprint) and `component_id`."""
    rows = cut(with_fingerprint(docs, text_col, width).select(*[F.col(f"`{c}`") for c in kept], "__fp"))
    fps = rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(F.col(id_col)).alias("low"))
    roots = components(links(fps.select("fp"), most))
    rooted = cut(fps.join(roots, fps.fp == roots.node, "left").select(F.col("fp").alias("__fp"), "low", F.coalesce("root", "fp").alias("__root")))
    lows = rooted.groupBy("__root").agg(F.min("low").alias("component_id"))
    named = cut(hot_join(rooted.drop("low"), lows, "__root").select("__fp", "__root", "component_id"))
    return hot_join(rows, named, "__fp")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """docs without its text but with `fingerprint` (16 hex digits) and `component_id` (least id of the component)."""
    kept = [c for c in docs.columns if c not in (text_col, "fingerprint", "component_id")]
    hex_of = F.lower(F.lpad(F.hex("__fp"), 16, "0"))
    return _rooted(docs, id_col, text_col, width, most, kept).select(*[F.col(f"`{c}`") for c in kept], hex_of.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """docs with exactly one row for each class: the one with the class's least id (null ids come last). Of different rows
    of a class with that id the one with the least hash is kept, of equal rows one."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__row", F.xxhash64(*columns, *[c.isNull() for c in columns]))
    rows = _rooted(keyed.select(F.col(f"`{id_col}`").alias("__id"), text_col, "__row"), "__id", text_col, width, most, ["__id", "__row"])
    counted = rows.groupBy("__root", "__id", "__row").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("__root").agg(F.min(F.struct(F.col("__id").isNull().alias("void"), "__id", F.col("__row").alias("row"), "n")).alias("head"))
    heads = cut(first.select(F.col("head.__id").alias("__id"), F.col("head.row").alias("row"), F.col("head.n").alias("n")))
    pick = lambda wanted: keyed.join(wanted, (keyed["__row"] == wanted["row"]) & keyed[id_col].eqNullSafe(wanted["__id"]))
    several = heads.where("n > 1")
    if several.limit(1).count() == 0:
        return pick(heads).select(*columns)
    # equal rows meet only where a head is one of them, and each task passes one of them on
    return pick(heads.where("n = 1")).select(*columns).unionAll(pick(several).dropDuplicates(["__id", "row"]).select(*columns))
