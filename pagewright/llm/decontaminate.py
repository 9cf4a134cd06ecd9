"""Benchmark decontamination with DataFrame functions only.

Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. A benchmark item's windows are its
runs of WINDOW consecutive words; an item of fewer words is one window. A document word inside any occurrence of a
window is hit; a document is contaminated if hits make up at least `least_share` of its words.

How windows are found. Of any WINDOW consecutive item words, one stretch of ANCHOR words begins at a multiple of
WINDOW - ANCHOR + 1 in the item: the window's anchor. The anchors' hashes (with the windows they stand for) are the set
that is broadcast; the documents' words are scanned once, the hash of each stretch of ANCHOR words is probed, and each
hit is verified by comparing the window's words. Short items have shorter anchors, the whole item, and are probed by
their own length. The set is broadcast if it takes at most BROADCAST_BYTES. A larger one is joined by a shuffle: of the positions only those
that pass a bitmap of the anchors' hashes, of fixed size, cross it, with the words about them; hot anchors are salted.

The scan explodes word positions inside one codegen stage, next to the probe; only one row per text and its verified
hits leave it. Hits are gathered per id and text, so repeated rows get equal results.

Defined cases: a null, empty or wordless text has no words, no hits and isn't contaminated; an item without words has
no window. Equal items are all reported; an item with a null id has windows, but no name to report. Very long texts are
scanned whole, like others. Empty tables give empty or unhit results. Extra columns pass through; columns
named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import HOT_LEAST, HOT_SHARE, cut

WINDOW, ANCHOR = 13, 7
#: Bytes of windows with their items that are broadcast, and what a row or a word takes besides its letters.
BROADCAST_BYTES, ROW_BYTES = 1 << 27, 64
#: Where they are more: bits of the filter that is broadcast instead (4 MB), and parts that a hot anchor's positions are dealt to.
FILTER_BITS, SALTS = 1 << 25, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII characters that separate words: all but digits and letters.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Contaminated (id, md5) that are broadcast to the documents; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
OUTPUTS = ("n_words", "n_hit", "items", "hits", "contaminated")


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null. Letters and separators are mapped in one pass, which is a third of a
    regular expression's time."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _stretch(words: str, at: Column, n: int) -> Column:
    """Hash of the n words from the 0-based position `at`."""
    return F.xxhash64(F.lit(n), *[F.get(F.col(words), at + k) for k in range(n)])


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(anchor hash, offset of the anchor in the window, window words, size, items) for the distinct windows."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    starts = items.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))))
    step = window - anchor + 1
    long = F.col("n") >= window
    size = F.when(long, F.lit(window)).otherwise(F.col("n"))
    offset = F.when(long, F.pmod(-F.col("start"), F.lit(step))).otherwise(F.lit(0)).cast("int")
    cut = starts.select("item_id", F.slice("words", F.col("start") + 1, size).alias("window"), size.cast("int").alias("size"), offset.alias("offset"))
    whole = cut.groupBy("window", "size", "offset").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hashes = F.when(F.col("size") >= anchor, _stretch("window", F.col("offset"), anchor))
    for n in range(1, anchor):
        hashes = F.when(F.col("size") == n, _stretch("window", F.lit(0), n)).otherwise(hashes)
    return whole.withColumn("anchor", hashes)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, md5, copies, n_words, items, hits): one row for each different (id, text), found in one pass over the texts."""
    found = windows(benchmark, anchor=anchor)
    weight = F.octet_length(F.array_join("window", "")) + ROW_BYTES * (1 + F.size("window") + F.size("items"))
    sizes = found.groupBy("size").agg(F.sum(weight).alias("bytes")).collect()  # at most one row for each number of words up to the window's
    lengths = sorted({min(r["size"], anchor) for r in sizes}) or [anchor]
    probe = found.select(F.col("anchor").alias("__anchor"), "offset", "window", "size", "items")
    small = sum(r["bytes"] for r in sizes) <= broadcast_bytes
    probe = F.broadcast(probe) if small else probe
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("md5"), words_of(F.col(text_col)).alias("words"))
    # position -1 stands for the text itself, so that texts without a hit stay; explode_outer, as the optimizer would
    # otherwise repeat the tokenising in a filter that it infers; one explode for positions and anchor lengths, so that
    # the words stay inside one codegen stage
    many = len(lengths)
    rows = rows.select("*", F.explode_outer(F.sequence(F.lit(-1), F.size("words") * many - 1)).alias("__k"))
    rows = rows.withColumn("at", F.when(F.col("__k") < 0, -1).otherwise(F.floor(F.col("__k") / many).cast("int"))) if many > 1 else rows.withColumn("at", F.col("__k"))
    words, at = F.col("words"), F.col("at")
    key = None
    for i, k in enumerate(lengths):
        chosen = (at >= 0) & (at <= F.size("words") - k)
        chosen = chosen & (F.col("__k") % many == i) if many > 1 else chosen
        key = F.when(chosen, _stretch("words", at, k)) if key is None else key.when(chosen, _stretch("words", at, k))
    keyed = rows.withColumn("__anchor", key)
    if small:
        met = keyed.withColumn("n", F.size("words")).withColumn("in_words", at).join(probe, "__anchor", "left")
    else:
        # what crosses the shuffle is the words about a position that may be an anchor's, not the text's
        low = F.greatest(at - (WINDOW - 1), F.lit(0))
        keyed = in_filter(keyed.where((at >= 0) & F.col("__anchor").isNotNull()), probe)
        keyed = cut(keyed.select("id", "md5", F.lit(None).cast("int").alias("n"), F.slice("words", low + 1, 2 * WINDOW).alias("words"), (at - low).alias("in_words"), "at", "__anchor"))
        dealt, dealt_probe = salted(keyed, probe)
        met = dealt.join(dealt_probe, ["__anchor", "__salt"]).drop("__salt")
        # the texts themselves take no part in the join
        texts = rows.where(at == -1).select("id", "md5", F.size("words").alias("n"), F.array().cast("array<string>").alias("words"), at.alias("in_words"), "at", F.lit(None).cast("long").alias("__anchor"))
        met = met.unionByName(texts, allowMissingColumns=True)
    first = F.col("in_words") - F.col("offset")
    fits = (first >= 0) & (first + F.col("size") <= F.size("words"))
    same = F.slice(words, F.greatest(first, F.lit(0)) + 1, F.col("size")) == F.col("window")
    kept = met.where((at == -1) | (F.col("size").isNotNull() & fits & same))
    span = F.struct((at - F.col("offset")).alias("start"), "size")
    kept = kept.select("id", "md5", (at == -1).alias("whole"), F.when(at == -1, F.col("n")).alias("n_words"), F.when(at >= 0, span).alias("span"), F.when(at >= 0, F.col("items")).alias("items"))
    whole = kept.groupBy("id", "md5").agg(F.count_if("whole").alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.collect_set("span").alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    return whole.select("id", "md5", "copies", "n_words", F.array_sort(F.array_distinct("items")).alias("items"), hits.alias("hits"))


def in_filter(keyed: DataFrame, probe: DataFrame) -> DataFrame:
    """Those rows of keyed whose __anchor may be one of probe's: a bitmap of FILTER_BITS bits in rows of 64, so of fixed size, is broadcast."""
    slot = lambda: F.pmod(F.col("__anchor"), F.lit(FILTER_BITS))
    bit = "cast(pmod(__anchor, 64) as int)"
    marks = probe.select(F.floor(slot() / 64).cast("long").alias("__row"), F.expr(f"shiftleft(1L, {bit})").alias("__bit")).groupBy("__row").agg(F.bit_or("__bit").alias("__bits"))
    met = keyed.withColumn("__row", F.floor(slot() / 64).cast("long")).join(F.broadcast(marks), "__row")
    return met.where(F.expr(f"getbit(__bits, {bit}) = 1")).drop("__row", "__bits")


def salted(keyed: DataFrame, probe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with `__salt`: positions of a hot anchor, of which there are fewer than HOT_SHARE, are dealt to SALTS parts, and their windows are
    repeated in each. keyed is read twice, so it should be a written table."""
    least = max(HOT_LEAST, keyed.count() / HOT_SHARE)
    hot = [r[0] for r in keyed.groupBy("__anchor").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select("__anchor").collect()]
    is_hot = F.col("__anchor").isin(hot) if hot else F.lit(False)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    own = F.when(is_hot, F.pmod(F.xxhash64("id", "md5", "at"), F.lit(SALTS)).cast("int")).otherwise(0)
    return keyed.withColumn("__salt", own), probe.withColumn("__salt", F.explode(salts))


def judged(found: DataFrame, least_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """found with n_hit and contaminated."""
    up, down = least_share
    out = found.withColumn("n_hit", F.size("hits").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (down * F.col("n_hit") >= up * F.col("n_words")))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: tuple[int, int] = (1, 20), **how) -> DataFrame:
    """docs with n_words, n_hit, items (ids of the items with occurring windows, sorted), hits (positions of the hit
    words, 0-based and sorted) and contaminated (n_hit > 0 and n_hit / n_words >= least_share)."""
    kept = [c for c in docs.columns if c not in OUTPUTS]
    found = judged(scan(docs, benchmark, id_col, text_col, **how), least_share).alias("s")
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("__md5")).alias("d")
    joined = own.join(found, F.col(f"d.`{id_col}`").eqNullSafe(F.col("s.id")) & (F.col("d.__md5") == F.col("s.md5")))
    return joined.select(*[F.col(f"d.`{c}`") for c in kept], *[F.col(f"s.{c}") for c in OUTPUTS])


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the contaminated documents (mode "documents"), or with the hit words cut from all texts together with
    what separates them from the word before (mode "spans")."""
    if mode == "documents":
        bad = cut(judged(scan(docs, benchmark, id_col, text_col, **how)).where("contaminated").select("id", "md5"))
        small = bad.count() <= BROADCAST_ROWS
        same = docs[id_col].eqNullSafe(bad["id"]) & (F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")) == bad["md5"])
        return docs.join(F.broadcast(bad) if small else bad, same, "left_anti")
    found = find(docs, benchmark, id_col, text_col, **how)
    if mode != "spans":
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    word, gap = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(gap + word), F.lit(0))
    tail = F.regexp_extract(F.col(text_col), gap + r"\z", 0)
    left = F.filter(pieces, lambda _, k: ~F.array_contains("hits", k))
    text = F.when(F.col("n_hit") > 0, F.concat(F.array_join(left, ""), tail)).otherwise(F.col(text_col))
    return found.withColumn("__text", text).select(*[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
