"""Operators against brute force, on the small tables."""

import hashlib
import re
import time

import numpy as np
import pandas as pd
import pytest

from pagewright.llm import html_extract, pii, queries, simhash, suffix_dedup

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)


def result(spark, f, **how):
    return f(spark, SF, **how).toPandas().sort_values("doc_id", ignore_index=True)


def test_op5_matches_all_pairs(spark, docs):
    got = result(spark, queries.op5_simhash)
    want = [brute.fingerprint(t) for t in docs["text"]]
    assert got["fingerprint"].tolist() == [f"{x:016x}" for x in want]
    assert got["component_id"].tolist() == brute.components(docs["doc_id"].tolist(), want)


def test_links_at_each_distance(spark):
    rng = np.random.default_rng(5)
    fps, chain = [], int(rng.integers(0, 2**63))
    for k in range(400):
        fps.append(chain)
        for b in rng.choice(64, 1 + k % 6, replace=False).tolist():
            chain ^= 1 << b
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(set(fps))]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute.components(signed, [x % (1 << 64) for x in signed])
    assert got == want


def test_large_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    base = 0x0F0F0F0F12345678
    near = sorted({base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(24)})
    frame = spark.createDataFrame([(x,) for x in near], "fp long")
    roots = simhash.components(simhash.links(frame)).select("root").distinct().collect()
    assert [r.root for r in roots] == [near[0]]


def test_op8_matches_all_strings(spark, docs):
    got = result(spark, queries.op8_suffix_dedup)
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == brute.repeats(docs["text"])


@pytest.mark.parametrize("hot", [20_000, 3])
def test_op8_edges(spark, hot):
    line = "the quick brown fox jumps over the lazy dog and goes on to the end of it all. "
    texts = [None, "", "short", line * 12, "x" * 401, "x" * 500, "é" * 300, "a" + line[:70] + "b" * 390, *(f"{k} head {k * 7919} " + line * 6 + f" tail {k * k}" for k in range(12)), "abc" * 400, line * 12, "Z" + "é" * 250]
    frame = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, n_spans string")
    got = suffix_dedup.dedup(frame, hot=hot).toPandas().sort_values("doc_id")
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == brute.repeats(texts)
    kept = suffix_dedup.remove(frame, hot=hot).toPandas().sort_values("doc_id")["text"].tolist()
    assert kept[0] is None and kept[2] == "short" and kept[5] == "" and kept[1] == ""


def test_op8_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 900)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 5000)
    import random

    rnd = random.Random(8)
    part = "".join(rnd.choice("abcdef ") for _ in range(1500))
    texts = ["".join(rnd.choice("uvwxyz ") for _ in range(900)) + part[k * 40 : 1500 - k * 90] + "".join(rnd.choice("uvwxyz ") for _ in range(2000)) for k in range(6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.dedup(frame).toPandas().sort_values("doc_id")
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == brute.repeats(texts)


def test_op8_passages_around_400_bytes(spark, tmp_path):
    """Passages of over 50 words that two documents share are removed from 400 bytes on; other documents are left alone."""
    rng = np.random.default_rng(400)
    words = lambda n: " ".join("".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (n, 5)))
    passages = [words(70)[:n] for n in (310, 394, 399, 400, 401)]
    assert min(len(p.split()) for p in passages) > 50
    texts = [f"{words(60)} {own}{p}{own} {words(60)}" for p in passages for own in "AB"] + [words(190) for _ in range(4)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_suffix_dedup(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    removed = [len(p) if len(p) >= 400 else 0 for p in passages for _ in "AB"] + [0] * 4
    assert got["n_removed"].tolist() == removed and got["removed"].tolist() == [n > 0 for n in removed]
    assert got["n_bytes"].tolist() == [len(t) for t in texts]


def test_op9_base_spans(spark, docs):
    got = result(spark, queries.op9_pii)
    for text, row in zip(docs["text"], got.itertuples(), strict=True):
        base = brute.base_spans(text)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert [s for s in row.spans.split(",") if s and not s.startswith("term")] == [s for s in said.split(",") if s]


def test_op9_terms(spark, docs):
    """Terms and their spans on a table with copies, from counts over all pairs."""
    terms = brute.disclosing(docs["text"])
    texts = docs["text"].value_counts()
    assert len(terms) > 20 and texts.max() > 1
    found = {r.term: r.bits for r in pii.disclosing(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert found.keys() == terms.keys() and all(abs(found[t] - terms[t]) < 1e-9 for t in terms)
    got = result(spark, queries.op9_pii)
    for text, row in zip(docs["text"], got.itertuples(), strict=True):
        base = brute.base_spans(text)
        want = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text or "") if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert row.spans == ",".join(f"{(*pii.KINDS, pii.TERM)[k]}:{a}:{b}" for a, k, b in sorted(base + want))


def test_op8_equal_hashes_of_different_windows(spark, docs, monkeypatch):
    """Every window hash is forced to be one of two; the results stay those of the bytes."""
    original = suffix_dedup.Hasher.rolling
    monkeypatch.setattr(suffix_dedup.Hasher, "rolling", lambda self, data, width: original(self, data, width) % np.uint64(2) if width == 40 else original(self, data, width))
    own = [t for t in docs["text"] if t is not None and len(t) < 1500][:60]
    texts = [*own, "abcabcabc" * 30, "xyz" + "abcabcabc" * 20, "abcabcabd" * 12, "ab" * 300, own[0][:90] + own[1][:70]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.dedup(frame, length=40, key=12).toPandas().sort_values("doc_id")
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == brute.repeats(texts, 40)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_op8_short_strings_of_few_letters(spark, hot):
    """Ties of all kinds: windows of twelve bytes over two letters, and texts that repeat themselves."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(5, 120, 150)] + ["a" * 60, "ab" * 40, "aab" * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.dedup(frame, length=12, key=4, hot=hot).toPandas().sort_values("doc_id")
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == brute.repeats(texts, 12)


def test_op8_ranks_against_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(200):
        m, middle = int(rng.integers(2, 9)), b"M" * 4
        runs = sorted({(bytes(rng.choice([65, 66], int(rng.integers(0, 9))).astype(np.uint8)), bytes(rng.choice([65, 66], int(rng.integers(0, 9))).astype(np.uint8))) for _ in range(m)})
        runs = [(a + middle + b, len(a)) for a, b in runs if len(a) + len(b) >= 8]
        got = {(k, x) for k, a, b in suffix_dedup.spans_by_ranks(runs, 12) for x in range(a, b - 11)}
        at = lambda k, d: runs[k][0][runs[k][1] - d :][:12] if d <= runs[k][1] and len(runs[k][0]) - runs[k][1] + d >= 12 else None
        want = {(k, runs[k][1] - d) for k in range(len(runs)) for d in range(9) if at(k, d) and any(at(k, d) == at(j, d) for j in range(len(runs)) if j != k)}
        assert got == want


def test_op5_each_choice_of_bands(spark, monkeypatch):
    """All pairs within the distance are found for any number of bands, and where every cell counts as large."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base.tolist():
        for n in (1, 3, 4, 5):
            y = x
            for b in rng.choice(64, n, replace=False).tolist():
                y ^= 1 << b
            fps.add(y)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute.components(signed, [x % (1 << 64) for x in signed])
    for agree, cell in ((3, 8192), (5, 8192), (8, 8192), (3, 1)):
        monkeypatch.setattr(simhash, "bands_for", lambda n, most, k=agree: k)
        monkeypatch.setattr(simhash, "CELL", cell)
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
        assert [roots.get(x, x) for x in signed] == want


def test_op5_bands_follow_the_number():
    assert [simhash.bands_for(n, 4) for n in (0, 10**6, 10**7, 10**9, 10**10, 10**12)] == [3, 3, 3, 6, 7, 8]


def test_op1_blocks_by_another_parser(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    for page in pages["html"]:
        mine = [(text, round(share, 2) > 0.5, *rest) for text, share, *rest in html_extract.blocks(page or "")]
        assert mine == [(text, round(share, 2) > 0.5, *rest) for text, share, *rest in brute.blocks(page)]
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op1_html_extraction(spark, SF).collect()}
    assert got == {k: (html_extract.main_text(page), len(html_extract.main_text(page))) for k, page in zip(pages["page_id"], pages["html"], strict=True)}


PROSE = "This is one of the long paragraphs that are in the page for the sake of the test of it."


@pytest.mark.parametrize(
    "page",
    [
        f"<article><p data-x=it's>{PROSE}</p><p>{PROSE}</p></article>", f"<title>x<p>{PROSE}</p><p>{PROSE}</p>", f"<noscript><p>{PROSE}</p><textarea><p>{PROSE}</p>", f"<!-- x ><p>{PROSE}</p><p>{PROSE}</p>",
        f"<svg><svg>a</svg>b</svg><p>{PROSE}</p><object><object>c</object>d</object><p>{PROSE}</p>", f"<svg><svg>a</svg><p>{PROSE}</p><p>{PROSE}</p>", f"<a x='><p>{PROSE}</p><p>{PROSE}</p>", f"<p title = \"a > b\">{PROSE}</p><p href=/?q='s>{PROSE}</p>",
        f"<head><p>{PROSE}</p><p>{PROSE}</p>", f"<p>{PROSE}</p><button>{PROSE}</button><p>{PROSE}</p>", f"<p>{PROSE}</p><select><option>a<option>b</select><p>{PROSE}</p>",
    ],
)
def test_op1_loses_no_text(page):
    assert html_extract.main_text(page) == f"{PROSE} {PROSE}"


@pytest.mark.parametrize("piece", ["<a ", "<button>x", "<title>", "<!--", "<div class=\"", "<a ='\">", "<svg>", "<div></x>", "<a x=y'", "<p a-", "</p", "<option>", "<? ", "<p a='", "<svg></svg", "<a=\"'>", "<p " + "-" * 40])
def test_op1_takes_linear_time(piece):
    """Ten times the page takes about ten times as long, also where a tag end stands behind everything."""
    for tail in ("", ">"):
        times = []
        for n in (100_000, 1_000_000):
            page = piece * (n // len(piece)) + tail
            began = time.perf_counter()
            html_extract.main_text(page)
            times.append(time.perf_counter() - began)
        assert times[1] < 40 * times[0] + 0.3 and times[1] < 3
