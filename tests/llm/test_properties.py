"""Kernels against plain versions on random input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import html_extract, pii, simhash, suffix_dedup, toxicity

from . import brute


@settings(max_examples=400, deadline=None)
@given(st.text("a1 2.3@-b+4()0%5_\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute.base_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abAÄé \t\n\x0b ", max_size=80), st.integers(1, 6))
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width) == brute.fingerprint(text, width)


@settings(max_examples=200, deadline=None)
@given(st.text("<>/!-=\"'ab &;pdivscriptn\n", max_size=80))
def test_any_markup_is_read(page):
    text = html_extract.main_text(page)
    assert text == " ".join(text.split())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 400), st.integers(1, 50))
def test_sliding_min(n, w):
    x = np.random.default_rng(n).integers(0, 50, n + w - 1).astype(np.uint64)
    assert suffix_dedup.sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(n)]


@given(st.integers(0, 500))
def test_windows_cover_and_overlap(n):
    starts = toxicity.windows_of(n)
    seen = {k for a in starts for k in range(a, a + toxicity.WINDOW)}
    assert seen >= set(range(n)) and all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, 2000, dtype=np.uint64), rng.integers(0, 2**64, 2000, dtype=np.uint64)
    counts = lambda x: np.array([[bin(int(v) >> (2 * s) & 3).count("1") for s in range(32)] for v in x])
    manhattan = np.abs(counts(a) - counts(b)).sum(1)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()
