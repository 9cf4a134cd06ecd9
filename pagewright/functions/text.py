"""Text expressions. All are Column functions inside codegen, but for `nfkc` and `match_ratio`, which Spark lacks."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords that make a line heading-like.
HEADING_KEYWORDS = (
    "introduction", "conclusion", "abstract", "appendix", "references", "acknowledgment", "acknowledgement", "methodology",
    "results", "discussion", "background", "evaluation", "biographies",
)
ROMAN, LETTER, ARABIC = r"^[IVX]+\.\s*", r"^[A-Z]\.\s*", r"^\d+[.)]\s*"
#: White space of ASCII, spelled out so that every engine takes the same characters.
ASCII_SPACE = r"[ \t\n\x0B\f\r]+"


def collapse(text: Column, space: str = r"(?U)\s+") -> Column:
    """One space for each run of white space, none at the ends. By default Unicode white space counts."""
    return F.trim(F.regexp_replace(text, space, " "))


def drop_invisible(text: Column) -> Column:
    """Without soft hyphens, zero-width spaces and byte order marks."""
    return F.translate(text, "\u00ad\u200b\ufeff", "")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, which no built-in function does."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalised(text: Column) -> Column:
    """NFKC, without invisible characters, white space collapsed."""
    return collapse(drop_invisible(nfkc(text)))


@F.pandas_udf(T.DoubleType())
def match_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks. Quadratic: for short texts."""
    return pd.Series([0.0 if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)])


def word_set(text: Column) -> Column:
    """Distinct lower-case words, split at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), ASCII_SPACE), lambda w: w != ""))


def jaccard(left: Column, right: Column) -> Column:
    """Of two word sets; 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(both / (F.size(left) + F.size(right) - both))


def word_jaccard(a: Column, b: Column) -> Column:
    """Structural comparison: no shortcut for equal texts."""
    return jaccard(word_set(a), word_set(b))


def block_similarity(a: Column, b: Column) -> Column:
    """Block mapping: 1 for texts equal but for case and outer space, else word Jaccard; 0 if either is empty."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    return F.when(_void(a) | _void(b), 0.0).when(x == y, 1.0).otherwise(word_jaccard(x, y))


def containing_similarity(a: Column, b: Column) -> Column:
    """Vision matching: as block_similarity, but a text inside the other gives the ratio of their lengths."""
    return containing(prepared(a), prepared(b))


def prepared(a: Column) -> Column:
    """What containing() needs of a text: without case and outer space, its length and its word set. Null for a void one."""
    x = F.trim(F.lower(a))
    return F.when(~_void(a), F.struct(x.alias("text"), F.length(x).alias("size"), word_set(x).alias("words")))


def containing(a: Column, b: Column) -> Column:
    """containing_similarity of prepared texts, so that texts in many pairs are split once each."""
    x, y = a["text"], b["text"]
    ratio = F.least(a["size"], b["size"]) / F.greatest(a["size"], b["size"])
    inside = F.contains(x, y) | F.contains(y, x)
    return F.when(a.isNull() | b.isNull(), 0.0).when(x == y, 1.0).when(inside, ratio).otherwise(jaccard(a["words"], b["words"]))


def pagination_similarity(a: Column, b: Column) -> Column:
    """Pagination: 1 if equal, .95 if one holds the other, else word Jaccard."""
    x, y = collapse(F.lower(a)), collapse(F.lower(b))
    return F.when(_void(a) | _void(b), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.95).otherwise(word_jaccard(x, y))


def _void(text: Column) -> Column:
    return text.isNull() | (text == "")


def is_upper(text: Column) -> Column:
    """Some upper-case letter and no lower-case one."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def has_numbering(text: Column) -> Column:
    return text.rlike(ROMAN) | text.rlike(LETTER) | text.rlike(ARABIC)


def is_heading_like(text: Column) -> Column:
    return F.lower(text).rlike("|".join(HEADING_KEYWORDS)) | (is_upper(text) & (F.length(text) < 50)) | text.rlike(ROMAN) | text.rlike(LETTER)


def strip_numbering(text: Column) -> Column:
    """Without a Roman, an Arabic and a letter prefix, in this order."""
    for pattern in (r"^[IVXivx]+\.\s*", r"^\d+\.?\s*", r"^[A-Z]\.\s*"):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def normalise_title(text: Column) -> Column:
    """Without section numbers and punctuation, lower-case."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\d.]+\s*", ""), r"(?U)[^\w\s]", "")
    return F.trim(F.lower(bare))


def normalise_label(text: Column) -> Column:
    """Lower-case with underscores; null if blank."""
    return F.nullif(F.translate(F.lower(F.trim(text)), "- ", "__"), F.lit(""))


def dense_length(text: Column) -> Column:
    """Characters without white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def sentences(text: Column, separator: str = ". ", least: int = 30) -> Column:
    """Sentences of more than `least` characters after a split at full stops."""
    parts = F.split(F.replace(text, F.lit(separator), F.lit(".\n")), "\n")
    return F.filter(F.transform(parts, F.trim), lambda s: F.length(s) > least)


#: LaTeX's special characters and typographic ones.
LATEX_FIRST = (("\u2013", "--"), ("\u2014", "---"), ("\u2212", "-"))
LATEX_ESCAPES = (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))
LATEX_MACROS = (("\u00a0", "~"), ("\u2003", r"\quad "), ("\u2002", r"\enspace "), ("\u2022", r"\ensuremath{\bullet}"), ("\u2192", r"\ensuremath{\rightarrow}"), ("\u2190", r"\ensuremath{\leftarrow}"))


def latex_escape(text: Column) -> Column:
    """LaTeX-safe text. Backslashes wait as U+0001 U+0003 while the others are escaped, and a U+0001 of the text as U+0001
    U+0002, so that neither is taken for the other; macros come last, so nothing that was put in is escaped again."""
    first, last = (("\x01", "\x01\x02"), ("\\", "\x01\x03")), (("\x01\x03", r"\textbackslash{}"), ("\x01\x02", "\x01"))
    text = F.coalesce(text, F.lit(""))
    for what, by in (*first, *LATEX_FIRST, *LATEX_ESCAPES, *last, *LATEX_MACROS):
        text = F.replace(text, F.lit(what), F.lit(by))
    return text


def caption_escape(text: Column) -> Column:
    """Caption text on one line, LaTeX-safe."""
    return latex_escape(collapse(F.coalesce(text, F.lit(""))))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}"))


def has_math(text: Column) -> Column:
    return text.rlike(r"[%$€£+=<>]")


def sentence_ends(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[.!?]"))


def bullets(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[•●○✓*]"))


def retry_text(seconds: Column) -> Column:
    """Seconds below 90, else whole minutes, rounded up."""
    minutes = F.ceil(seconds / 60).cast("long")
    return F.when(seconds < 90, F.format_string("%d seconds", seconds.cast("long"))).otherwise(F.format_string("%d minutes", minutes))
