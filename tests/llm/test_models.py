"""The learnt operators, through their queries, against plain versions: loops over words, n-grams, steps and bytes."""

import hashlib
import io
import math
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.llm import audio, langid, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def result(spark, f):
    return f(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)


def test_op4_bytes(spark, docs):
    got = result(spark, queries.op4_audio)
    stored = {r.doc_id: bytes(r.media["data"]) for r in audio.store(table(spark, "documents").select("doc_id", "text")).collect()}
    assert got["doc_id"].tolist() == docs["doc_id"].tolist()
    for text, r in zip(docs["text"], got.itertuples(), strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        with wave.open(io.BytesIO(stored[r.doc_id])) as w:
            assert w.getsampwidth() == 1 and w.getnchannels() == 1 and w.readframes(w.getnframes()) == payload
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
    same = got.assign(text=docs["text"]).groupby("text")["feature"].nunique()
    assert (same == 1).all() and got["feature"].nunique() > 100


def grams(text, classes):
    """The n-grams of a text as tuples of letter classes."""
    row = [0]
    for c in text:
        k = int(classes[min(ord(c), 0xFFFF)])
        if k or row[-1]:
            row.append(k)
    row += [0] if row[-1] else []
    out = [(a,) for a in row if a]
    out += [(a, b) for a, b in zip(row, row[1:]) if a or b]  # noqa: B905
    return Counter(out + [(a, b, c) for a, b, c in zip(row, row[1:], row[2:]) if b])  # noqa: B905


def place_of(gram):
    """The order of equally frequent n-grams: shorter ones first, then by letters."""
    return (len(gram), gram)


def test_op6_out_of_place_distances(spark, docs):
    classes, size = langid.letter_classes(), 400
    held = [zlib.crc32(str(k).encode()) % 5 == 0 for k in docs["doc_id"]]
    totals: dict[str, Counter] = {}
    for text, lang, out in zip(docs["text"], docs["lang"], held, strict=True):
        if not out and lang is not None and text is not None:
            totals.setdefault(lang, Counter()).update(grams(text, classes))
    profiles = {lang: {x: k for k, x in enumerate(sorted(n, key=lambda x: (-n[x], place_of(x)))[:size])} for lang, n in totals.items()}
    known = set().union(*profiles.values())
    got = result(spark, queries.op6_language)
    assert got["held_out"].tolist() == held
    for text, r in zip(docs["text"], got.itertuples(), strict=True):
        own = {x: n for x, n in grams(text or "", classes).items() if x in known}
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        top = sorted(own, key=lambda x: (-own[x], place_of(x)))[:size]
        cost = {lang: sum(abs(p[x] - k) if x in p else size for k, x in enumerate(top)) / (len(top) * size) for lang, p in profiles.items()}
        best = min(cost, key=lambda g: (cost[g], g))
        assert r.lang_pred == best and r.score == pytest.approx(1 - cost[best])


def test_op6_any_number_of_languages(spark):
    """As many languages as documents, more of them than profiles of 16-bit slots have room for."""
    rng = np.random.default_rng(6)
    words = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9F00, 400)) for _ in range(300)]
    train = spark.createDataFrame([(k, w, f"lang{k}") for k, w in enumerate(words)], "doc_id long, text string, lang string")
    profiles = langid.fit(train)
    assert len(profiles.langs) == 300
    got = {r.doc_id: r.language["lang_pred"] for r in langid.predict(train, profiles).collect()}
    assert np.mean([got[k] == f"lang{k}" for k in range(300)]) > 0.95


TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


def buckets(text):
    out, last = [], None
    for token in TOKEN.findall(text or ""):
        b = zlib.crc32(token.encode()) % (quality.BUCKETS - 1) + 1
        out.append(quality.REPEAT if b == last else b)
        last = b
    return out


def test_op3_vectors_pooling_and_scores(spark, docs):
    at, sign = quality.index_vectors()
    sums = np.zeros((quality.BUCKETS, quality.DIMS))
    for text in docs["text"]:
        ids = buckets(text)
        for a, b in zip(ids, ids[1:]):  # noqa: B905
            for x, y in ((a, b), (b, a)):
                for p, s in zip(at[y], sign[y], strict=True):
                    sums[x, p] += s
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    want = np.where(norms > 0, sums / np.maximum(norms, 1e-9), 0)
    frame = table(spark, "documents")
    vectors = quality.word_vectors(frame)
    assert np.abs(vectors - want).max() < 1e-6
    network = quality.fit(frame, table(spark, "labels"), vectors)
    w, b, v, c = network.parts
    got = result(spark, queries.op3_quality)
    assert got["held_out"].tolist() == [zlib.crc32(str(k).encode()) % 3 == 1 for k in docs["doc_id"]]
    for text, r in zip(docs["text"], got.itertuples(), strict=True):
        rows = want[buckets(text)]
        x = np.concatenate([rows.mean(0), rows.std(0)]) if len(rows) else np.zeros(2 * quality.DIMS)
        x = (x - network.shift) / network.scale
        hidden = [math.tanh(sum(x[i] * w[i, j] for i in range(len(x))) + b[j]) for j in range(quality.HIDDEN)]
        p = 1 / (1 + math.exp(-(sum(h * u for h, u in zip(hidden, v, strict=True)) + float(c)) / network.temperature))
        assert r.score == pytest.approx(p, abs=1e-4) and r.predicted == int(r.score >= 0.5)


def window_logit(net, words):
    """One window, word by word."""
    p, n = net.p, toxicity.HIDDEN
    known = net.inputs(words)[0] if words else np.zeros((0, 2 * toxicity.EMBED))
    states = []
    for side in range(2):
        h, seen = np.zeros(n), []
        for x in known if side == 0 else known[::-1]:
            gate, own = x @ p["wx"][side] + p["b"][side][0], h @ p["u"][side]
            z, r = (1 / (1 + np.exp(-(gate[k * n : k * n + n] + own[k * n : k * n + n]))) for k in range(2))
            c = np.tanh(gate[2 * n :] + r * own[2 * n :])
            h = z * h + (1 - z) * c
            seen.append(h)
        states.append(seen if side == 0 else seen[::-1])
    if not words:
        return float((np.zeros(2 * n) @ p["wo"] + p["bo"])[0])
    both = [np.concatenate(s) for s in zip(*states, strict=True)]
    e = np.array([np.tanh(s @ p["wa"] + p["ba"]) @ p["va"] for s in both])
    share = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return float((sum(a * s for a, s in zip(share, both, strict=True)) @ p["wo"] + p["bo"])[0])


def test_op10_scores(spark, docs):
    net = toxicity.fit(table(spark, "documents").select("doc_id", "text"), table(spark, "labels"))
    got = result(spark, queries.op10_toxicity)
    assert got["held_out"].tolist() == [zlib.crc32(str(k).encode()) % 5 == 0 for k in docs["doc_id"]]
    for text, r in list(zip(docs["text"], got.itertuples(), strict=True))[::4]:
        words = toxicity.words_of(text)
        best = max(window_logit(net, words[a : a + toxicity.WINDOW]) for a in toxicity.windows_of(len(words)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(net.slope * best + net.shift))), abs=2e-3) and r.predicted == int(r.score >= 0.5)


def test_op10_gradients_are_finite_differences():
    rng = np.random.default_rng(1)
    net = toxicity.Network(seed=1)
    ids = np.array([[0, 1, 2, 3, 1], [2, 4, -1, -1, -1], [-1] * 5])
    gates = rng.normal(0, 1, (2, 6, 3 * toxicity.HIDDEN)).astype(np.float32)
    gates[:, 5] = 0
    d = rng.normal(0, 1, 3).astype(np.float32)
    value = lambda: float((net.forward(gates, ids)[0].astype(np.float64) * d).sum())
    grads, d_gates = net.backward(d, ids, gates, net.forward(gates, ids, keep=True)[1])
    step = 1e-2
    for name, (array, grad) in {**{k: (net.p[k], grads[k]) for k in ("u", "wa", "ba", "va", "wo", "bo")}, "gates": (gates, d_gates)}.items():
        for _ in range(12):
            at = tuple(int(rng.integers(0, min(n, m))) for n, m in zip(array.shape, grad.shape, strict=True))
            before = array[at]
            array[at] = before + step
            up = value()
            array[at] = before - step
            down = value()
            array[at] = before
            assert grad[at] == pytest.approx((up - down) / (2 * step), abs=5e-3), name


def test_op10_trains_on_all_windows():
    """A long text's only toxic word, far behind, is learnt."""
    rng = np.random.default_rng(3)
    words = [f"word{k}" for k in range(80)]
    texts, y = [], []
    for k in range(120):
        own = list(rng.choice(words, 3000 if k % 10 == 0 else 60))
        if k % 2:
            own[-1 if k % 3 else len(own) // 2] = "vileness"
        texts.append(" ".join(own))
        y.append(k % 2)
    net = toxicity.Network().fit(texts, np.array(y, float), np.ones(len(y)))
    assert ((net.scores(texts) >= 0.5) == (np.array(y) == 1)).mean() > 0.95


def test_stable_sample_bounds_rows_and_bytes(spark):
    from pagewright.llm.common import stable_sample

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"), F.when(F.col("id") % 2 == 0, 10).otherwise(1000).alias("size"))
    got = {r.label: r for r in stable_sample(rows, "label", 500, 100_000, F.col("size"), 1, weight="w").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum("w").alias("w")).collect()}
    assert abs(got[0].n - 500) < 100 and abs(got[1].bytes - 100_000) < 40_000 and abs(got[0].w - 2000) < 400
    assert stable_sample(rows, "label", 5000, 10**9, F.col("size"), 1).count() == 4000
