"""op8 where one bucket has more runs than a task gathers: results against plain counts, and how many windows are dealt."""

import numpy as np
import pytest

from pagewright.llm import suffix_dedup

from . import brute

COLUMNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def deduped(spark, texts, **how):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = suffix_dedup.dedup(frame, **how).toPandas().sort_values("doc_id")
    return list(got[COLUMNS].itertuples(index=False, name=None))


def test_windows_of_a_common_passage_are_not_all_dealt(spark, monkeypatch):
    """300 texts around one passage: some kinds of windows for each chunk of neighbours are written, not the hundreds of each text."""
    written = []

    def counted(df, cut=suffix_dedup.cut):
        df = cut(df)
        if "md5" in df.columns:
            written.append(df.count())
        return df

    monkeypatch.setattr(suffix_dedup, "cut", counted)
    rng = np.random.default_rng(300)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    passage = letters(700)
    texts = [letters(500) + passage + letters(500) for _ in range(300)]
    assert deduped(spark, texts, hot=50) == brute.repeats(texts)
    assert len(written) == 1 and written[0] < 100 * len(texts)


@pytest.mark.parametrize(("chunk", "seed"), [(2, 0), (5, 1), (4096, 2)])
def test_chunks_of_any_size(spark, monkeypatch, chunk, seed):
    """Near copies, texts of few letters and texts that repeat themselves; pairs of equal windows lie in one chunk or in several."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(seed)
    text = lambda n, of="abcdefgh": "".join(rng.choice(list(of), n))
    passage, unit = text(70), text(7)
    texts = [text(int(rng.integers(0, 40))) + passage[int(rng.integers(0, 30)) : int(rng.integers(40, 71))] + text(int(rng.integers(0, 40))) for _ in range(80)]
    texts += [text(int(rng.integers(0, 9))) + unit * int(rng.integers(1, 9)) + text(int(rng.integers(0, 20))) for _ in range(40)]
    texts += [text(int(rng.integers(5, 90)), "ab") for _ in range(40)] + ["a" * 60, "ab" * 40, "aab" * 30, *texts[:3]]
    for length, key in ((12, 4), (24, 6)):
        assert deduped(spark, texts, length=length, key=key, hot=1) == brute.repeats(texts, length)
