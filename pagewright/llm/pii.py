"""PII by information-theoretic sanitisation.

Base detectors find e-mail addresses, IP addresses, card and phone numbers: the protected entities. Then corpus
co-occurrence tells which terms reveal one of them. All probabilities are shares of the N different texts:

    P(e)   = n(e) / N                 n(e): texts that hold the entity e
    P(e|t) = n(e, t) / (n(t) + 1)     n(t): texts that hold the term t; n(e, t): texts in which t stands within NEAR words of e
    IC(e)  = -log2 P(e)               the information in e
    PMI(e, t) = log2(P(e|t) / P(e))   what t discloses of it; IC(e) - PMI(e, t) = -log2 P(e|t) is left

The one in P(e|t) is a text that hasn't been seen, so that no term is certain: one that occurs in a single text, beside e, leaves
one bit. A term is disclosing if it leaves at most `left_bits` (1: most of its texts have e nearby) and discloses at
least the share `least_share` of IC(e) (so that an entity which stands in a large part of all texts has no disclosing terms).
There is no least number of texts, so entities of one text have disclosing terms, too. Wherever a disclosing term
occurs it gets a span of kind `term`; `sanitise` removes a term that leaves at most `remove_bits`, and replaces
another by its general form ([NAME], [WORD]). Base entities are replaced by their kind.

A term is a run of three or more letters in lower case, outside of base spans. Words count towards NEAR whatever their length.
Counts cover all documents, and a text counts once however often it repeats, in all four numbers: words of a text with c
copies are counted apart by c and divided by it, which is exact. Only the hashes of
repeated texts are sent to the tasks, if they are at most BROADCAST_COPIES; otherwise the texts are made distinct
before they are counted. Terms' frequencies are summed per task before they are shuffled. The disclosing terms are sent to
the tasks if they are at most BROADCAST_BYTES; otherwise a bitmap of 2 ** SLOT_BITS hash slots is sent, words that pass it
are joined to the terms, and each row gets its own terms. Both ways give the same result.

Defined cases: a null text is an empty one and has no spans. Repeated rows get equal spans. An empty table gives
an empty result. Texts are read whole; detectors and neighbourhoods take linear time. Of a term that reveals several entities
the least left counts. Other columns pass through; `spans` (and, in `sanitise`, the text column) is replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import by_parts, cut, parts_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR, LEFT_BITS, LEAST_SHARE, REMOVE_BITS = 8, 1.0, 0.5, 0.42
#: Bytes of disclosing terms that are sent to the tasks, with TERM_BYTES for each term besides its letters.
BROADCAST_BYTES, TERM_BYTES = 1 << 25, 64
#: Slots of the bitmap that is sent where the terms are more.
SLOT_BITS = 24
#: Hashes of repeated texts that are sent to the tasks.
BROADCAST_COPIES = 1_000_000
#: Distinct words that a task counts before it passes the counts on.
HELD_WORDS = 200_000

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base entities, in order."""
    if not text:
        return []
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        low = at
        while low > done and text[low - 1] in LOCAL:
            low -= 1
        m = DOMAIN.match(text, at + 1) if low < at else None
        if m:
            out.append((low, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NO_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """The entity of a span in one spelling."""
    piece = text[span[0] : span[2]]
    return f"{KINDS[span[1]]}:{piece.lower() if span[1] < 2 else NO_DIGIT.sub('', piece)}"


def terms_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the terms of a text, in order: its words without those that touch base spans."""
    out, k, reach = [], 0, 0
    for m in WORD.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def nearby(text: str, base: list[tuple[int, int, int]]) -> set[tuple[str, str]]:
    """(entity, term) for the NEAR terms on either side of each base span."""
    terms = terms_of(text, base)
    starts = [a for a, _ in terms]
    out = set()
    for span in base:
        k, e = bisect_left(starts, span[0]), entity(text, span)
        out.update((e, text[a:b].lower()) for a, b in terms[max(0, k - NEAR) : k + NEAR])
    return out


def _key(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 9)
    return h - (1 << 64) if h >> 63 else h


def with_copies(docs: DataFrame, text_col: str = "text", broadcast_copies: int = BROADCAST_COPIES) -> DataFrame:
    """(text, copies): rows without null texts and how many rows have the same text; or each text once, with 1."""
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    key = F.xxhash64("text")
    repeated = cut(texts.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    if repeated.count() > broadcast_copies:
        return texts.distinct().withColumn("copies", F.lit(1).cast("long"))
    return texts.join(F.broadcast(repeated), key == F.col("key"), "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))


def statistics(docs: DataFrame, text_col: str = "text", broadcast_copies: int = BROADCAST_COPIES) -> DataFrame:
    """(what, key, entity, term, n), each text counted once: n(t) for what = 0, n(e, t) for 1, n(e) for 2 and N for 3."""

    def run(batches):
        counts: dict[tuple[str, int], int] = {}

        def flush():
            if counts:
                yield rows([(0, _key(w), None, None, c, n) for (w, c), n in counts.items()])
                counts.clear()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["what", "key", "entity", "term", "of", "n"])

        for batch in parts_of(batches):
            met: set[tuple] = set()
            for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts["", copies] = counts.get(("", copies), 0) + 1
                for w in set(map(str.lower, WORD.findall(text))):
                    counts[w, copies] = counts.get((w, copies), 0) + 1
                if len(counts) > HELD_WORDS:
                    yield from flush()
                base = base_spans(text)
                if base:
                    text_key = _key(text)
                    met |= {(1, _key(t), _key(e), t, text_key, 1) for e, t in nearby(text, base)}
                    met |= {(2, 0, _key(entity(text, s)), None, text_key, 1) for s in base}
            if met:
                yield rows(list(met))
        yield from flush()

    # `of` holds the copies for what = 0, where '' stands for any text, and the text's key for 1 and 2
    found = with_copies(docs, text_col, broadcast_copies).mapInArrow(run, "what int, key long, entity long, term string, of long, n long")
    met = found.groupBy("what", "key", "entity", "term", "of").agg(F.sum("n").alias("n"))
    once = F.when(F.col("what") == 0, F.expr("n div of")).otherwise(1)
    whole = met.groupBy("what", "key", "entity", "term").agg(F.sum(once).alias("n"))
    return cut(whole.withColumn("what", F.when((F.col("what") == 0) & (F.col("key") == _key("")), 3).otherwise(F.col("what"))))


def disclosing(docs: DataFrame, text_col: str = "text", left_bits: float = LEFT_BITS, least_share: float = LEAST_SHARE, broadcast_copies: int = BROADCAST_COPIES) -> DataFrame:
    """(term, bits): the disclosing terms and what the strongest of them leaves of its entity's information."""
    found = statistics(docs, text_col, broadcast_copies)
    every = found.where("what = 3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    terms = found.where("what = 0").select("key", F.col("n").alias("n_term"))
    entities = found.where("what = 2").select("entity", F.col("n").alias("n_entity"))
    joined = found.where("what = 1").join(terms, "key").join(entities, "entity")
    p_term, p = F.least(F.col("n") / (F.col("n_term") + 1), F.lit(1.0)), F.col("n_entity") / F.lit(float(max(every, 1)))
    judged = joined.select("term", F.abs(F.log2(p_term)).alias("bits"), (F.log2(p_term) - F.log2(p)).alias("pmi"), F.abs(F.log2(p)).alias("ic"))
    return judged.where((F.col("bits") <= left_bits) & (F.col("pmi") > 0) & (F.col("pmi") >= least_share * F.col("ic"))).groupBy("term").agg(F.min("bits").alias("bits"))


def term_spans(text: str, base: list[tuple[int, int, int]], terms) -> list[tuple[int, int, int]]:
    """Spans of the disclosing terms outside of base spans."""
    if not terms or terms.keys().isdisjoint(map(str.lower, WORD.findall(text))):
        return []
    return [(a, len(KINDS), b) for a, b in terms_of(text, base) if text[a:b].lower() in terms]


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """Which of 2 ** SLOT_BITS slots, by crc32, terms fall into: a bitmap of fixed size."""
    slot = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(1 << SLOT_BITS)) + 1  # Spark counts from 1
    parts = terms.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out, width = np.zeros((1 << SLOT_BITS) // 8, np.uint8), 4096
    for r in parts:
        out[(r.part - 1) * width : r.part * width] = np.frombuffer(bytes(r.bits), np.uint8)[: len(out)]
    return out


def passing(text: str | None, bitmap: np.ndarray) -> list[str]:
    """The different terms of a text whose slot is set."""
    out = []
    for w in set(map(str.lower, WORD.findall(text or ""))):
        slot = zlib.crc32(w.encode("utf-8", "surrogatepass")) % (1 << SLOT_BITS)
        if bitmap[slot >> 3] >> (slot & 7) & 1:
            out.append(w)
    return out


def _applied(docs: DataFrame, text_col: str, out: str, schema: str, work, left_bits: float = LEFT_BITS, least_share: float = LEAST_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with `out`: work(text, disclosing terms and their bits) of each row, in one pass through Python."""
    found = cut(disclosing(docs, text_col, left_bits, least_share))
    size = found.agg(F.sum(F.octet_length("term") + TERM_BYTES)).first()[0] or 0
    if size <= broadcast_bytes:
        terms = {r.term: r.bits for r in found.collect()}

        @F.pandas_udf(schema)
        def by_all(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from by_parts(lambda part: pd.Series([work(t, terms) for t in part], dtype=object))(texts)

        return docs.withColumn(out, by_all(F.col(text_col)))

    bitmap = bitmap_of(found)

    @F.pandas_udf("array<string>")
    def candidates(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from by_parts(lambda part: pd.Series([passing(t, bitmap) for t in part], dtype=object))(texts)

    @F.pandas_udf(schema)
    def by_own(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = lambda own: {x["term"]: x["bits"] for x in (own if own is not None else [])}
        yield from by_parts(lambda texts, own: pd.Series([work(t, of(o)) for t, o in zip(texts, own, strict=True)], dtype=object))(columns)

    # a row may get terms of another text with the same hash, which change nothing: its own words are looked up in them
    keyed = docs.withColumn("__key", F.xxhash64(F.col(text_col)))
    words = keyed.select("__key", F.explode(candidates(F.col(text_col))).alias("term")).distinct()
    own = words.join(found, "term").groupBy("__key").agg(F.collect_list(F.struct("term", "bits")).alias("__own"))
    return keyed.join(own, "__key", "left").withColumn(out, by_own(F.col(text_col), F.col("__own"))).drop("__key", "__own")


def spans_of(text: str | None, terms: dict[str, float]) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of base entities and disclosing terms, in order."""
    base = base_spans(text)
    return sorted(base + term_spans(text, base, terms)) if text else base


def detect(docs: DataFrame, text_col: str = "text", out: str = "spans", **how) -> DataFrame:
    """docs with `out`: an array of (kind, start, end, bits), base entities and disclosing terms by start, then kind."""
    names = (*KINDS, TERM)

    def spans(text: str | None, terms: dict[str, float]) -> list[dict]:
        return [{"kind": names[k], "start": a, "end": b, "bits": terms[text[a:b].lower()] if k == len(KINDS) else None} for a, k, b in spans_of(text, terms)]

    return _applied(docs, text_col, out, "array<struct<kind string, start long, end long, bits double>>", spans, **how)


def sanitise(docs: DataFrame, text_col: str = "text", remove_bits: float = REMOVE_BITS, **how) -> DataFrame:
    """docs with a sanitised text: base entities become [EMAIL], [IP], [CARD] or [PHONE], disclosing terms are removed or
    generalised. Of spans that overlap, the first counts and takes the others' text with it. Null stays null."""

    def clean(text: str | None, terms: dict[str, float]) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for a, k, b in spans_of(text, terms):
            if a < at:
                at = max(at, b)
                continue
            parts.append(text[at:a])
            at = b
            if k < len(KINDS):
                parts.append(f"[{KINDS[k].upper()}]")
            elif terms[text[a:b].lower()] > remove_bits:
                parts.append("[NAME]" if text[a].isupper() else "[WORD]")
        return "".join(parts) + text[at:]

    # found and replaced in one kernel: two in a row keep two Python workers for each core, and an executor's memory has no room for them
    found = _applied(docs, text_col, "__clean", "string", clean, **how)
    return found.select(*[F.col("__clean").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
