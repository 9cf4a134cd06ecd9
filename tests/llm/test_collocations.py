"""Phrase mining against plain counts, chunk borders, the bitmap, sums beyond 64 bits, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def plain(rows, longest=4, least=30, inside=80, scale=2_000_000, top=2000):
    f, n = plain_counts(rows, longest)
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= inside * a:
                continue
            score, _, l, r = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -score) for k, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]  # noqa: E741
    return sorted(out)


def made(seed, docs=300):
    r = random.Random(seed)
    words = ["the", "The", "of", "new york", "new york city", "é", "😀", "a\xa0b", "of the state", "x", "\x00", "san  \tjose", "hot key"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!?", ";", ":"]
    rows = [(r.choice(["en", "de", None, "", "x\ty"]), "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 80)))) for _ in range(docs)]
    return rows + [("en", None), ("en", ""), (None, ". , \n"), ("alone", "a b c")] + [("en", "one long copied line of text")] * 90


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("old"))


def values(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("options", [{}, {"least": 5, "inside": 60, "top": 40}, {"longest": 3, "least": 2}, {"longest": 2, "least": 9, "top": None}, {"longest": 5, "least": 20, "scale": 1000}])
def test_equals_plain_counts(spark, options):
    rows = made(1)
    want = plain(rows, **(options | ({"top": 10**9} if options.get("top", 0) is None else {})))
    assert len(want) > 5 and values(collocations.mine(frame(spark, rows), **options)) == want


def test_many_shards_and_chunks_and_a_full_bitmap(spark, monkeypatch):
    rows = made(2, 200)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 3000)
    monkeypatch.setattr(collocations, "CHUNK", 97)
    assert values(collocations.mine(frame(spark, rows), least=3)) == plain(rows, least=3)
    # every bit set: nothing is filtered, nothing changes
    monkeypatch.setattr(collocations, "filter_of", lambda pairs: np.full(1 << 10, 255, np.uint8))
    assert values(collocations.mine(frame(spark, rows), least=3)) == plain(rows, least=3)


def test_bitmap_holds_all_and_little_else(spark):
    r = np.random.default_rng(0)
    inside, outside = (r.integers(0, 2**64, 30_000, dtype=np.uint64) for _ in range(2))
    inside[:3] = [0, 2**63, 2**64 - 1]
    bits = collocations.filter_of(spark.createDataFrame([(int(x),) for x in inside.view(np.int64)], "pair long"))
    assert collocations.in_filter(bits, inside).all() and collocations.in_filter(bits, outside).mean() < 0.05
    assert len(bits) * 8 <= collocations.FILTER_BITS


def test_suffix_array_by_plain_sorting():
    r = random.Random(4)
    for _ in range(200):
        ids = np.array([r.choice([-1, 0, 1, 2]) for _ in range(r.randint(1, 40))])
        order, lcp = collocations.suffix_array(ids, 4)
        heads = [tuple(ids[i : i + 4]) for i in order]
        assert heads == sorted(tuple(ids[i : i + 4]) for i in range(len(ids)))
        for k in range(1, len(ids)):
            same = 0
            while same < min(len(heads[k]), len(heads[k - 1])) and heads[k][same] == heads[k - 1][same]:
                same += 1
            assert lcp[k] == same


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 4 * 10**18
    rows = [("en", 0, None, big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 3), ("en", 2, "b a", big // 5 * 4), ("en", 3, "a b a", big // 5 * 4 - 3)]
    monkeypatch.setattr(collocations, "counts", lambda *a, **k: spark.createDataFrame(rows, "lang string, words int, phrase string, n long"))
    got = {r.phrase: r for r in collocations.mine(spark.createDataFrame([], "lang string, text string")).collect()}
    # 100 * f(longer) falls short of 80 * a for `a b` alone
    assert set(got) == {"a b", "a b a"}
    assert got["a b"].score == 2_000_000 * (big - 3) // (big + big - 1)
    assert got["a b a"].score == min(2_000_000 * (big // 5 * 4 - 3) // (big + big // 5 * 4), 2_000_000 * (big // 5 * 4 - 3) // (big - 3 + big))


def test_empty_tables_and_one_text_of_many_words(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", "..")], "lang string, text string")).count() == 0
    rows = [("en", "a b " * 50_000), ("en", "a b")]
    assert values(collocations.mine(spark.createDataFrame(rows, "lang string, text string"))) == plain(rows)


def test_shards_end_by_bytes():
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 5, "text": ["x" * 5_000_000, None, "y" * 4_000_000, "", "z"]})
    assert [[len(t or "") for t in texts.to_pylist()] for _, texts in collocations.shards(iter([batch, batch]))] == [[5_000_000, 0, 4_000_000], [0, 1, 5_000_000, 0, 4_000_000], [0, 1]]
