"""Matching a reference version of a document against a generated one."""

from __future__ import annotations

import difflib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import geometry as g
from pagewright.functions import text as t


def candidates(ref: DataFrame, gen: DataFrame, score: Column, keep: Column, pages: int = 1) -> DataFrame:
    """Pairs of blocks of one document whose pages differ by `pages` at most, with a score. Pages are dealt to the page
    buckets they can meet in, so the join is on equality and no document's pages are all paired."""
    near = gen.withColumn("__page", F.explode(F.array(*[F.col("page") + d for d in range(-pages, pages + 1)])))
    near = near.select("doc_id", "__page", *[F.col(c).alias(f"gen_{c}") for c in gen.columns if c != "doc_id"])
    mine = ref.select("doc_id", F.col("page").alias("__page"), *[F.col(c).alias(f"ref_{c}") for c in ref.columns if c != "doc_id"])
    return mine.join(near, ["doc_id", "__page"]).drop("__page").withColumn("score", score).where(keep)


def vision_candidates(ref: DataFrame, gen: DataFrame) -> DataFrame:
    """Block pairs for vision matching: .4 overlap + .6 text - .1 a page; valid above .4, with overlap above .2 or text
    above .4."""
    overlap = g.iou(g.box("ref_"), g.box("gen_"))
    text = t.containing(F.col("ref___text"), F.col("gen___text"))
    score = 0.4 * overlap + 0.6 * text - 0.1 * F.abs(F.col("ref_page") - F.col("gen_page"))
    ready = lambda side: side.withColumn("__text", t.prepared(F.col("text")))
    return candidates(ready(ref), ready(gen), score, (F.col("score") > 0.4) & ((overlap > 0.2) | (text > 0.4))).drop("ref___text", "gen___text")


def structural_candidates(ref: DataFrame, gen: DataFrame, cross_page: bool = True) -> DataFrame:
    """Block pairs for structural matching: mean of overlap and text, less .1 off the page; overlap .2 or text .3."""
    overlap = g.iou(g.box("ref_"), g.box("gen_"))
    text = t.jaccard(F.col("ref___words"), F.col("gen___words"))
    score = 0.5 * overlap + 0.5 * text - F.when(F.col("ref_page") != F.col("gen_page"), 0.1).otherwise(0.0)
    # a text is cut into words once, not for each pair it is in
    ready = lambda side: side.withColumn("__words", t.word_set(F.col("text")))
    return candidates(ready(ref), ready(gen), score, (F.col("score") > 0) & ((overlap >= 0.2) | (text >= 0.3)), 2 if cross_page else 0).drop("ref___words", "gen___words")


def greedy(pairs: DataFrame, by: str = "doc_id", ref: str = "ref_ord", gen: str = "gen_ord", score: str = "score") -> DataFrame:
    """One-to-one pairs: each reference block in order takes the best block that is still free; of equals, the first.
    The choice depends on all earlier ones of the document, so its candidates pass through one task in order; what the task
    holds are the blocks already taken."""

    def assign(batches):
        of, taken, done = object(), set(), object()
        for batch in batches:
            keep = []
            for k, (d, r, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in (by, ref, gen)), strict=True)):
                if d != of:
                    of, taken, done = d, set(), object()
                if r != done and x not in taken:
                    done = r
                    taken.add(x)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return pairs.repartition(by).sortWithinPartitions(by, ref, F.desc(score), gen).mapInArrow(assign, pairs.schema)


def outline_pairs(ref: DataFrame, gen: DataFrame, least: float = 0.5) -> DataFrame:
    """Section titles of one document, paired greedily by match ratio above `least`."""
    left = ref.select("doc_id", F.col("ord").alias("ref_ord"), F.col("title").alias("ref_title"))
    right = gen.select("doc_id", F.col("ord").alias("gen_ord"), F.col("title").alias("gen_title"))
    pairs = left.join(right, "doc_id").withColumn("score", t.match_ratio(t.normalise_title(F.col("ref_title")), t.normalise_title(F.col("gen_title"))))
    return greedy(pairs.where(F.col("score") > least))


def kth_duplicates(ref: DataFrame, gen: DataFrame, by: list[str], key: str, order: list[str]) -> DataFrame:
    """Pairs the k-th row of a key on one side with the k-th on the other."""
    ranked = lambda df, side: df.withColumn("k", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))).select(*by, key, "k", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in (*by, key)])
    return ranked(ref, "ref").join(ranked(gen, "gen"), [*by, key, "k"])


def missing(ref: DataFrame, gen: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ref without an equal in gen."""
    return ref.join(gen.select(*on).distinct(), on, "left_anti")


#: Texts of the reference that one pass over the generated side looks for; generated texts that are compared at once.
SOUGHT, TOGETHER = 4096, 4096
#: Classes that letters and letter pairs are dealt to by their codes.
LETTERS, LETTER_PAIRS = 61, 251


def fuzzy_missing(ref: DataFrame, gen: DataFrame, text: str, most: float = 0.85) -> DataFrame:
    """Rows of ref for whose text no text of gen has a match ratio above `most`. Equal texts are met by a
    join. The others are compared with every different text of gen, by bounds first that no match above `most` breaks:
    the lengths, the letters in common, the letter pairs in common (each unmatched letter parts one pair at most from
    the matched ones), the longest common subsequence."""
    gens = gen.select(text).where(F.col(text).isNotNull()).distinct()
    left = missing(ref, gens, [text])
    # a set number of tasks, as the planner would put the short texts of many into one
    tasks = max(4 * ref.sparkSession.sparkContext.defaultParallelism, gen.rdd.getNumPartitions())
    dealt, found, block = gens.repartition(tasks), [], []
    for row in left.select(text).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        block.append(row[0])
        if len(block) == SOUGHT:
            found.append(_near(dealt, block, text, most))
            block = []
    if block:
        found.append(_near(dealt, block, text, most))
    if not found:
        return left
    return left.join(reduce(DataFrame.unionAll, found).distinct(), text, "left_anti").select(*ref.columns)


def _counts(texts: list[str], pairs: bool) -> np.ndarray:
    """How often each class of letters, or of letter pairs, occurs in each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    rows, n = np.repeat(np.arange(len(texts)), sizes), LETTERS
    if pairs:
        same = rows[1:] == rows[:-1]
        codes, rows, n = (codes[:-1] * 31 + codes[1:])[same], rows[1:][same], LETTER_PAIRS
    return np.bincount(rows * n + codes % n, minlength=len(texts) * n).reshape(-1, n).astype(np.uint16 if sizes.max(initial=0) < 1 << 16 else np.int64)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = free = (1 << len(a)) - 1
    for c in b:
        hit = free & at.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def _near(gens: DataFrame, sought: list[str], text: str, most: float) -> DataFrame:
    """Those of the sought texts that have a match ratio above `most` with a text of gens, each once a task."""
    sought = sorted(sought, key=len)

    def run(batches):
        letters, pairs = _counts(sought, False), _counts(sought, True)
        longest = len(sought[-1]) * (2 - most) / most + 1
        open_ = set(range(len(sought)))
        for batch in batches:
            every = sorted((t for t in batch.column(0).to_pylist() if len(t) <= longest), key=len)
            for k in range(0, len(every), TOGETHER):
                texts = every[k : k + TOGETHER]
                sizes, own, own_pairs = np.fromiter(map(len, texts), np.int64, len(texts)), _counts(texts, False), _counts(texts, True)
                met = []
                for r in sorted(open_):
                    a = sought[r]
                    low, high = np.searchsorted(sizes, [len(a) * most / (2 - most) - 1, len(a) * (2 - most) / most + 1])
                    both = (sizes[low:high] + len(a)) * most / 2 - 1e-6
                    share = np.minimum(own[low:high], letters[r]).sum(1, dtype=np.int64)
                    near = np.flatnonzero(share > both)
                    near = near[np.minimum(own_pairs[low:high][near], pairs[r]).sum(1, dtype=np.int64) >= 3 * both[near] - 1 - (sizes[low:high][near] + len(a))]
                    for x in near[np.argsort(-share[near], kind="stable")]:
                        b = texts[low + x]
                        if common_subsequence(a, b) > both[x] and difflib.SequenceMatcher(None, a, b).ratio() > most:
                            met.append(r)
                            break
                open_.difference_update(met)
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array([sought[r] for r in met], pa.string())], names=[text])

    return gens.select(text).mapInArrow(run, f"`{text}` string")


def align(ref: DataFrame, gen: DataFrame, on: list[str], value: str, default) -> DataFrame:
    """All keys of either side, with flags for presence and a default for the missing side."""
    left, right = ref.select(*on, F.col(value).alias("__l"), F.lit(True).alias("__in_l")), gen.select(*on, F.col(value).alias("__r"), F.lit(True).alias("__in_r"))
    met = left.join(right, on, "full_outer")
    return met.select(*on, F.coalesce("__l", F.lit(default)).alias("ref_value"), F.coalesce("__r", F.lit(default)).alias("gen_value"), F.coalesce("__in_l", F.lit(False)).alias("in_ref"), F.coalesce("__in_r", F.lit(False)).alias("in_gen"))


def first_region(points: DataFrame, regions: DataFrame, by: list[str], default: str = "unknown", cells: int = 32) -> DataFrame:
    """The label of the first region (by `ord`) that holds each point (x, y), else `default`. Regions are dealt to the
    cells of a grid they touch and points to theirs, so only regions near a point are compared. The grid has `cells` cells along
    either axis of the regions' extent, whatever their unit."""
    ends = regions.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    if ends[0] is None:
        return points.withColumn("label", F.lit(default))
    wide, high = (max(float(ends[k + 1]) - float(ends[k]), 1e-9) / cells for k in (0, 2))
    at = lambda v, low, size: F.floor((v - float(low)) / size).cast("int")
    column, row = lambda v: at(v, ends[0], wide), lambda v: at(v, ends[2], high)
    dealt = regions.withColumn("__i", F.explode(F.sequence(column(F.col("x0")), column(F.col("x1"))))).withColumn("__j", F.explode(F.sequence(row(F.col("y0")), row(F.col("y1")))))
    dealt = dealt.select(*by, "__i", "__j", F.col("ord").alias("__ord"), F.col("label").alias("__label"), *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")])
    placed = points.withColumn("__i", column(F.col("x"))).withColumn("__j", row(F.col("y")))
    met = placed.join(dealt, [*by, "__i", "__j"]).where(g.contains_point(g.box("__"), F.col("x"), F.col("y")))
    first = met.groupBy(*points.columns).agg(F.min_by("__label", "__ord").alias("__found"))
    first = first.select(*[F.col(c).alias(f"__p_{c}") for c in points.columns], "__found")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__p_{c}")) for c in points.columns])
    return points.join(first, same, "left").select(*points.columns, F.coalesce("__found", F.lit(default)).alias("label"))


def word_coverage(pairs: DataFrame, ref: str, gen: str) -> DataFrame:
    """pairs with the numbers of different words that the reference has, that the other text has of these, that it lacks and that it
    adds, and the share it has; 0 for a reference without words."""
    r, x = t.word_set(F.coalesce(F.col(ref), F.lit(""))), t.word_set(F.coalesce(F.col(gen), F.lit("")))
    met = pairs.withColumn("__r", r).withColumn("__g", x).withColumn("n_ref", F.size("__r")).withColumn("n_found", F.size(F.array_intersect("__r", "__g")))
    met = met.withColumn("n_missing", F.col("n_ref") - F.col("n_found")).withColumn("n_extra", F.size("__g") - F.col("n_found"))
    return met.withColumn("coverage", F.coalesce(F.try_divide("n_found", "n_ref"), F.lit(0.0))).drop("__r", "__g")


def score_detections(truth: DataFrame, found: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """found with `gt_ord` and `hit`: each prediction takes the truth box of its label (figures and tables are one) with
    the best overlap of at least `least`; of the predictions that take one box, the first counts."""
    kind = lambda c: F.when(F.col(c).isin("figure", "table"), F.lit("figure|table")).otherwise(F.col(c))
    a = found.withColumn("__kind", kind("label"))
    b = truth.select(*by, F.col("ord").alias("gt_ord"), kind("label").alias("__kind"), *[F.col(c).alias(f"gt_{c}") for c in ("x0", "y0", "x1", "y1")])
    met = a.join(b, [*by, "__kind"]).withColumn("iou", g.clamped_iou(g.box(), g.box("gt_"))).where(F.col("iou") >= least)
    best = met.groupBy(*by, "ord").agg(F.max_by("gt_ord", F.struct("iou", -F.col("gt_ord"))).alias("gt_ord"), F.max("iou").alias("iou"))
    first = best.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "gt_ord").orderBy("ord")))
    return found.join(first.where("__k = 1").drop("__k"), [*by, "ord"], "left").withColumn("hit", F.col("gt_ord").isNotNull())


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return share(tp, tp + fp), share(tp, tp + fn), share(2 * tp, 2 * tp + fp + fn)


def detection_scores(truth: DataFrame, scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts of hits and misses, and their rates."""
    hits = scored.groupBy(*by).agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    there = truth.groupBy(*by).agg(F.count(F.lit(1)).alias("gt"))
    met = there.join(hits, by, "full_outer").na.fill(0, ["gt", "tp", "fp"]).withColumn("fn", F.col("gt") - F.col("tp"))
    precision, recall, f1 = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return met.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1)


def nearest_heading(headings: DataFrame, gen: DataFrame) -> DataFrame:
    """Where a heading's text is found again: on its page at the nearest height, else on the first other page."""
    spots = gen.select("doc_id", F.col("text").alias("title"), F.col("page").alias("gen_page"), F.col("y0").alias("gen_y"))
    met = headings.join(spots, ["doc_id", "title"], "left")
    far = F.col("gen_page") != F.col("page")
    rank = F.struct(far.cast("int"), F.when(far, F.col("gen_page").cast("double")).otherwise(F.abs(F.col("gen_y") - F.col("y0"))), F.col("gen_page"), F.col("gen_y"))
    found = met.groupBy("doc_id", "ord", "title", "page", "y0").agg(F.min_by(F.struct("gen_page", "gen_y"), F.when(F.col("gen_page").isNotNull(), rank)).alias("at"))
    status = F.when(F.col("at").isNull(), "MISSING").when(F.col("at.gen_page") != F.col("page"), "PAGE_MOVED").otherwise("FOUND")
    return found.select("doc_id", "ord", "title", "page", "y0", "at.gen_page", "at.gen_y", status.alias("status"))


def diff_health(matched: Column, ref: Column, gen: Column) -> Column:
    """Verdict on a comparison: too few generated blocks, too few matches, or valid."""
    rate = matched / F.greatest(F.lit(1), F.least(ref, gen))
    few = gen < F.greatest(F.lit(10), F.floor(0.1 * ref))
    return F.when(few, "INVALID_EXTRACTION").when(rate <= 0.2, "INVALID_MATCH_COVERAGE").otherwise("VALID")


