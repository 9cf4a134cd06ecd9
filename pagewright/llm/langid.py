"""Language ID by rank-order profiles.

A language's profile is its most frequent letter n-grams (1 to 3 letters, word boundaries count as a letter) in
order of frequency. A document's most frequent n-grams are compared to each profile: an n-gram costs the
difference between its two ranks, one that is missing from a profile costs the profile's length. The language
with the least mean cost wins; ties go to the language that sorts first.

Letters are dealt into 127 classes: a-z and the Latin letters from U+00DF to U+00FF have one each, all others share
the rest by code point. N-grams outside every profile cost the same for each language and are left out.

Profiles are fitted on at most about `per_lang` documents (default 400) and `sample_bytes` bytes of each language, drawn
by a hash of the id; there may be any number of languages. The n-grams are counted in the tasks, and only the `size` most
frequent ones of each language reach the driver; of equally frequent ones the least code comes first. Defined cases: a null text or one without a letter gives `und` with score 0, and so does any text where no
row has a language to learn from. A text of letters none of whose n-grams is known gives the language that sorts
first, with score 0. Texts of any length are read whole. Repeated rows get equal results, empty tables give
empty ones; other columns pass through, and one that is called like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import by_parts, parts_of, stable_sample

UNKNOWN = "und"
CLASSES = 128
#: Code points per numpy block; longer texts make a block of their own.
BLOCK = 1 << 18


def letter_classes() -> np.ndarray:
    """Class of each code point of the basic plane: 0 for all but letters, equal for upper and lower case."""
    out = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else low - 196 if 0xDF <= low <= 0xFF else 60 + low % 68
    return out


def codes(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram codes of some texts and the text each belongs to."""
    parts, owner = [], []
    for k, t in enumerate(texts):
        cps = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = classes[np.minimum(cps, 0xFFFF)].astype(np.int32)
        far = np.flatnonzero(cps > 0xFFFF)
        if far.size:
            cls[far] = [60 + int(c) % 68 if chr(c).isalpha() else 0 for c in cps[far]]
        keep = np.ones(len(cls), bool)
        keep[1:] = (cls[1:] != 0) | (cls[:-1] != 0)
        parts.append(cls[keep])
        owner.append(np.full(len(parts[-1]), k, np.int32))
    c, o = np.concatenate(parts), np.concatenate(owner)
    one = c != 0
    same2 = o[1:] == o[:-1]
    two = (c[:-1] + c[1:] > 0) & same2
    three = same2[1:] & same2[:-1] & (c[1:-1] != 0)
    two_codes = CLASSES + c[:-1] * CLASSES + c[1:]
    three_codes = CLASSES + CLASSES**2 + (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    return np.concatenate([c[one], two_codes[two], three_codes[three]]), np.concatenate([o[one], o[1:][two], o[1:-1][three]])


class Profiles:
    """Rank-order profiles of some languages."""

    def __init__(self, langs: list[str], tops: list[np.ndarray], size: int):
        self.langs, self.size = langs, size
        vocabulary = np.unique(np.concatenate(tops)) if tops else np.zeros(0, np.int64)
        self.n = len(vocabulary)
        self.slot = np.full(CLASSES + CLASSES**2 + CLASSES**3, self.n, np.uint16 if self.n < 1 << 16 else np.int32)
        self.slot[vocabulary] = np.arange(self.n)
        self.ranks = np.full((len(langs), self.n), size, np.int16 if size < 1 << 15 else np.int32)
        for k, top in enumerate(tops):
            self.ranks[k, self.slot[top]] = np.arange(len(top))

    def costs(self, texts: list[str], classes: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance of each text to each language, from 0 to 1; 2 where no n-gram is known."""
        code, owner = codes(texts, classes)
        width = self.n + 1
        counts = np.bincount(owner.astype(np.int64) * width + self.slot[code], minlength=len(texts) * width).reshape(len(texts), width)[:, :-1]
        key = counts * width - np.arange(self.n)
        most = min(self.size, self.n)
        top = np.argpartition(-key, most - 1, axis=1)[:, :most]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
        there = np.take_along_axis(counts, top, 1) > 0
        n = there.sum(1)
        out = np.full((len(texts), len(self.langs)), 2.0)
        place = np.arange(most, dtype=np.int32)
        for k in range(len(self.langs)):
            rank = self.ranks[k][top]
            d = np.where(there, np.where(rank < self.size, np.abs(rank.astype(np.int32) - place), self.size), 0).sum(1)
            out[:, k] = np.where(n > 0, d / np.maximum(n * self.size, 1), 2.0)
        return out

    def predict(self, texts: list[str | None], classes: np.ndarray) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.n:
            return langs, scores
        block, size = [], 0
        for k in [*range(len(texts)), None]:
            if block and (k is None or size > BLOCK or len(block) >= 64):
                for i, c in zip(block, self.costs([texts[i] for i in block], classes), strict=True):
                    best = int(c.argmin())
                    langs[i], scores[i] = self.langs[best], max(0.0, 1.0 - float(c[best]))
                block, size = [], 0
            if k is not None and texts[k] and any(map(str.isalpha, texts[k])):
                block.append(k)
                size += len(texts[k])
        return langs, scores


def fit(docs: DataFrame, per_lang: int = 400, size: int = 400, seed: int = 6, sample_bytes: int = 1 << 28) -> Profiles:
    """Profiles from docs' text and lang."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = stable_sample(known, "lang", per_lang, sample_bytes, F.octet_length("text"), seed).select("lang", "text")

    def count(batches):
        classes = letter_classes()
        for batch in parts_of(batches):
            langs, texts = (batch.column(i).to_pylist() for i in range(2))
            for lang in set(langs):
                own = [codes([t], classes)[0] for g, t in zip(langs, texts, strict=True) if g == lang and any(map(str.isalpha, t))]
                if own:
                    code, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counts = rows.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))  # a language has at most as many codes as there are n-grams
    top = counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "code", "place").toPandas().sort_values(["lang", "place"])
    langs = sorted(top["lang"].unique())
    return Profiles(langs, [top["code"].to_numpy(np.int64)[(top["lang"] == lang).to_numpy()] for lang in langs], size)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with the column `out`, a struct of lang_pred and score."""
    classes = letter_classes()

    def best(part: pd.Series) -> pd.DataFrame:
        langs, scores = profiles.predict(list(part), classes)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from by_parts(best)(texts)

    return docs.withColumn(out, guess(F.col(text_col)))
