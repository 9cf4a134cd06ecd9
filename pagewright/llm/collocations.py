"""Phrase collocation mining by suffix arrays of word ids.

Each task cuts its texts into shards of about SHARD_BYTES bytes. Of a shard's words it makes ids, sorts the suffixes of the id sequence by
prefix doubling in numpy (ranks by one word, two, four, ... up to the longest phrase), and reads n-gram counts off the intervals of
suffixes whose common prefixes (LCP) have n words or more. Counts of equal n-grams are merged by key, in the tasks first. Two passes:

1. Pairs of words are counted by a 64-bit hash of language and words. Those with `least` occurrences or more go into a bitmap of FILTER_BITS bits
   at most (32 MB; two bits a pair), which is collected and broadcast. Hashes that collide, and bits that others have set,
   let too much through and lose nothing; no count is taken from them.
2. A phrase that occurs `least` times has only such pairs, so sequences are broken where a pair isn't in the bitmap, and what is left is counted
   by its words, exactly. Single words are counted everywhere.

A candidate of n words is cut after each of its first n - 1 words; with l and r the counts of both parts a cut scores
floor(scale * a / (l + r)), and the lowest-scoring cut counts (ties: the first). Sums and products are decimals, so none overflows. A
candidate goes if a longer one that holds it has `inside` per cent of its count or more. The `top` best of each language
are returned (None: all).

Words, pieces, lower case: see `words_of`. Defined cases: null and empty texts have no words, a null language is `und`. Repeated rows
count each time. Rows of equal score and count are in the order of the phrase's bytes, so reruns agree. Empty tables give
empty tables; the input's other columns are ignored. A text of any length is read whole and split at once, which takes some twenty times
its bytes; its suffixes are sorted CHUNK words at a time with the following words looked at, so no phrase is lost between two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import cut, hot_join

UNKNOWN = "und"
SHARD_BYTES, CHUNK = 1 << 23, 1 << 21
FILTER_BITS, LEAST_BITS = 1 << 28, 1 << 20
#: Bits a bitmap's row has; fixed by Spark's bitmap functions.
BUCKET = 1 << 15
BREAK = "\n"


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Languages and texts of shards that end with the row which makes them SHARD_BYTES bytes."""
    held, size = [], 0

    def joined():
        whole = pa.Table.from_batches(held).combine_chunks()
        return tuple(whole.column(k).chunk(0) for k in range(2))

    for batch in batches:
        begin = 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            size += n
            if size >= SHARD_BYTES:
                held.append(batch.slice(begin, k + 1 - begin))
                yield joined()
                held, size, begin = [], 0, k + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield joined()


def words_of(langs: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """Word and language number of each word of some texts, in order, and the words and languages. A-Z are lower-cased, `[.,;:!?\\x0A-\\x0D]` end a
    piece, `[\\x20\\x09]` part words. After each piece and each text stands a word number of -1."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    texts = pc.replace_substring(pc.replace_substring_regex(texts, r"[.,;:!?\n-\r]+", f" {BREAK} "), "\t", " ")
    split = pc.split_pattern(pc.binary_join_element_wise(texts, BREAK, " "), " ")
    code = split.flatten().dictionary_encode()
    names = code.dictionary.to_pylist()
    known = pc.fill_null(langs, UNKNOWN).dictionary_encode()
    lang = np.repeat(known.indices.to_numpy(), pc.list_value_length(split).to_numpy())
    word = code.indices.to_numpy()
    kind = np.array([0 if w == "" else -1 if w == BREAK else 1 for w in names], np.int8)[word] if len(word) else np.zeros(0, np.int8)
    there = kind != 0
    return np.where(kind[there] < 0, -1, word[there]), lang[there], names, known.dictionary.to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values mixed well, as hashes of hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair_hashes(word: np.ndarray, lang: np.ndarray, names: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word and the next one are in one piece, and the hash of language and both words."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in names] or [0], np.uint64)[word]
    lang_hashes = np.array([xxhash.xxh64_intdigest(w, 1) for w in langs] or [0], np.uint64)[lang]
    there = np.zeros(len(word), bool)
    there[:-1] = (word[:-1] >= 0) & (word[1:] >= 0)
    out = np.zeros(len(word), np.uint64)
    out[:-1] = mixed(mixed(hashes[:-1] ^ lang_hashes[:-1]) + hashes[1:])
    return there, out


def dense(keys: np.ndarray) -> np.ndarray:
    """Each key's rank among the different keys, from 1 (0 is what stands after the end)."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def suffix_array(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `ids` in the order of their first `words` ids or more, and how many of those each has in common with the one before it (LCP)."""
    rank, step = dense(ids), 1
    while step < words:
        rank = dense(rank * (len(ids) + 2) + shifted(rank, step))
        step *= 2
    order = np.argsort(rank, kind="stable")
    lcp, same = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    same[:1] = False
    for k in range(words):
        value = shifted(ids + 2, k)[order]
        same[1:] &= value[1:] == value[:-1]
        lcp += same
    return order, lcp


def intervals(order: np.ndarray, lcp: np.ndarray, words: int, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of counted places of each interval of suffixes that agree in `words` ids."""
    begins = np.flatnonzero(lcp < words)
    if not len(begins):
        return begins, begins
    n = np.add.reduceat(counted[order].astype(np.int64), begins)
    return order[begins][n > 0], n[n > 0]


def chunks(n: int, words: int) -> Iterator[tuple[int, int, int]]:
    """Begin, end of what is counted and end of what is looked at, of each chunk."""
    for a in range(0, n, CHUNK):
        yield a, min(n, a + CHUNK), min(n, a + CHUNK + words - 1)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and count of each pair of neighbouring words of each shard."""
    for langs, texts in shards(batches):
        word, lang, names, lang_names = words_of(langs, texts)
        there, hashes = pair_hashes(word, lang, names, lang_names)
        ids = np.where(word >= 0, word.astype(np.int64) * max(1, len(lang_names)) + lang, -1)
        for a, b, c in chunks(len(ids), 2):
            order, lcp = suffix_array(ids[a:c], 2)
            counted = there[a:c].copy()
            counted[b - a :] = False
            first, n = intervals(order, lcp, 2, counted)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[a:c][first].view(np.int64)), pa.array(n)], names=["pair", "n"])


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    mask = np.uint64(len(bits) * 8 - 1)
    found = np.ones(len(hashes), bool)
    for shift in (0, 32):
        place = (hashes >> np.uint64(shift)) & mask
        found &= bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
    return found


def filter_of(pairs: DataFrame) -> np.ndarray:
    """A bitmap of the hashes in `pairs`: 16 bits for each, FILTER_BITS at most, two of them set. It reaches the driver in rows of
    BUCKET bits."""
    size = LEAST_BITS
    n = pairs.count()
    while size < 16 * n and size < FILTER_BITS:
        size *= 2
    # two separate places of the hash; Spark's bitmap functions count from 1
    places = [F.shiftrightunsigned("pair", shift).bitwiseAND(F.lit(size - 1)) + 1 for shift in (0, 32)]
    places = pairs.select(F.explode(F.array(*places)).alias("place"))
    rows = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        at = (r.bucket - 1) * (BUCKET // 8)
        part = np.frombuffer(bytes(r.bits), np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def linked_runs(linked: np.ndarray) -> np.ndarray:
    """The places of runs of linked words, with a -1 after each run."""
    inside = linked.copy()
    inside[1:] |= linked[:-1]
    at = np.flatnonzero(inside)
    ends = ~linked[at]
    out = np.full(len(at) + int(ends.sum()), -1, np.int64)
    out[np.arange(len(at)) + np.cumsum(ends) - ends] = at
    return out


def count_phrases(batches: Iterator[pa.RecordBatch], bits: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """lang, words (how many), phrase and n: of each shard all single words, and the phrases of 2 to `longest` words whose pairs are in the
    bitmap; the row of no words has a language's number of words."""

    def rows(lang: np.ndarray, words: int, phrases: pa.Array, n: np.ndarray, lang_names: list[str]) -> pa.RecordBatch:
        lang = pa.array(lang_names, pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), words, np.int32)), phrases, pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "n"])

    for langs, texts in shards(batches):
        word, lang, names, lang_names = words_of(langs, texts)
        there, hashes = pair_hashes(word, lang, names, lang_names)
        many = max(1, len(lang_names))
        strings = pa.array(names, pa.string())
        ids = word.astype(np.int64) * many + lang
        codes, n = np.unique(ids[word >= 0], return_counts=True)
        yield rows(codes % many, 1, strings.take(pa.array(codes // many)), n, lang_names)
        total = np.bincount(codes % many, weights=n, minlength=many).astype(np.int64)[: len(lang_names)]
        yield rows(np.arange(len(total)), 0, pa.nulls(len(total), pa.string()), total, lang_names)
        there[there] = in_filter(bits, hashes[there])
        run = linked_runs(there)
        run_ids = np.where(run >= 0, ids[run], -1)
        # how many words are left from a place up to the end of its run
        left = (run >= 0).astype(np.int64)
        for _ in range(longest - 1):
            left = np.where(run >= 0, 1 + np.minimum(shifted(left, 1), longest - 1), 0)
        for a, b, c in chunks(len(run), longest):
            order, lcp = suffix_array(run_ids[a:c], longest)
            for k in range(2, longest + 1):
                counted = left[a:c] >= k
                counted[b - a :] = False
                first, n = intervals(order, lcp, k, counted)
                first = run[a + first] if len(first) else first
                parts = [strings.take(pa.array(word[first + j])) for j in range(k)]
                yield rows(lang[first], k, pc.binary_join_element_wise(*parts, " "), n, lang_names)


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30) -> DataFrame:
    """lang, words, phrase, n: all phrases of 1 to `longest` words that occur `least` times or more in a language, and one row with
    words = 0 and a null phrase for each language, its number of words."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    pairs = cut(rows.mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair"))
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(pairs))
    found = rows.mapInArrow(lambda batches: count_phrases(batches, bits.value, longest), "lang string, words int, phrase string, n long")
    found = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least) | ((F.col("words") == 0) & (F.col("n") > 0)))


def _key(lang: str, phrase) -> F.Column:
    """Language and phrase in one string; a phrase has no tab, so its last one parts them."""
    return F.concat(F.col(lang), F.lit("\t"), phrase)


def _slice(begin: int, n: int) -> F.Column:
    return F.array_join(F.slice(F.split("phrase", " ", -1), begin, n), " ")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30, inside: int = 80, scale: int = 2_000_000, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` best phrases of 2 to `longest` words."""
    found = cut(counts(docs, lang_col, text_col, longest, least)).withColumn("key", _key("lang", F.col("phrase")))
    candidates = found.where(F.col("words") > 1)
    wide = lambda c: F.col(c).cast("decimal(19,0)")

    # both parts of each cut: at most 2 * (longest - 1) rows a candidate, joined to the parts' counts
    sides = [
        F.when(F.col("words") == n, F.array(*[F.struct(F.lit(j).alias("cut"), F.lit(s).alias("side"), _slice(1 + j * s, n - j if s else j).alias("part")) for j in range(1, n) for s in (0, 1)]))
        for n in range(2, longest + 1)
    ]
    parts = candidates.select("key", "lang", F.inline(F.coalesce(*sides))).select("key", "cut", "side", _key("lang", F.col("part")).alias("part"))
    facts = found.where(F.col("words") > 0).select(F.col("key").alias("part"), F.col("n").alias("f"))
    known = hot_join(parts, facts, "part")
    places = [(j, s) for j in range(1, longest) for s in (0, 1)]
    known = known.groupBy("key").agg(*[F.max(F.when((F.col("cut") == j) & (F.col("side") == s), F.col("f"))).alias(f"f{j}_{s}") for j, s in places])

    # the largest count of a longer candidate around each phrase
    inner = [
        F.when(F.col("words") == n, F.array(*[_slice(1 + at, k) for k in range(2, n) for at in range(n - k + 1)])) for n in range(3, longest + 1)
    ]
    around = candidates.select("lang", "n", F.explode(F.coalesce(*inner, F.array().cast("array<string>"))).alias("phrase")) if longest > 2 else candidates.limit(0).select("lang", "n", "phrase")
    around = around.select(_key("lang", F.col("phrase")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))

    score = lambda l, r: F.expr(f"cast({scale} as decimal(10,0)) * cast(n as decimal(19,0)) div (cast({l} as decimal(19,0)) + cast({r} as decimal(19,0)))")  # noqa: E731, E741
    cuts = [F.when(F.col(f"f{j}_0").isNotNull(), F.struct(score(f"f{j}_0", f"f{j}_1").alias("score"), F.lit(j).alias("cut"), F.col(f"f{j}_0").alias("l"), F.col(f"f{j}_1").alias("r"))) for j in range(1, longest)]
    judged = candidates.join(known, "key").join(around, "key", "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("n") * inside))
    judged = judged.select("lang", "phrase", F.col("n").alias("a"), (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = judged.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    totals = found.where(F.col("words") == 0).select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
