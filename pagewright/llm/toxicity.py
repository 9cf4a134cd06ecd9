"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector and the sum of the vectors of its character 4-grams (ends marked). Words and 4-grams
have a vector if they occur in at least LEAST_TEXTS training texts; others add nothing, so rare ones aren't learned by
heart. Every window of WINDOW words, STRIDE apart and so overlapping, is read in both
directions by gated recurrent units; attention over the words pools their states into one logit. A document's
score is that of its highest window, mapped to a probability by a logistic fit on the training documents.

Training takes all windows of a stable sample of at most about `per_label` labelled documents (default 1000) and
`sample_bytes` bytes of each label, weighted back to the labels' shares. Labels hold for documents,
not for windows: of a toxic document those windows count as toxic that hold a word or 4-gram which is at least ODDS times
as frequent in toxic texts as in others, with a log-likelihood ratio of RATIO or
more, in larger samples a twentieth of the toxic texts (where there is none, the window with the highest score). After the first round
each document's highest window weighs HARD times.

Scoring reads whole texts. Defined cases: a text without a word (null, empty, white) is one empty window. Without
labelled rows of both labels every score is the share of toxic labels (0 if there are none). Repeated rows get equal
scores. An empty table gives an empty result. Other columns pass through; a column named like the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import by_parts, labelled_sample, one_blas_thread

WINDOW, STRIDE = 32, 24
EMBED, HIDDEN, ATTEND, GRAM, LEAST_TEXTS = 8, 8, 8, 4, 5
BATCH, ROUNDS, RATE, DECAY, HARD, ODDS, RATIO = 256, 6, 0.01, 0.02, 4, 10, 15
#: Windows of a block of scoring, and words whose inputs a task remembers.
SCORED, HELD = 1024, 100_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[k : k + GRAM] for k in range(max(1, len(w) - GRAM + 1))]


def windows_of(n: int) -> list[int]:
    """First words of the windows over n words: every word is in one, and neighbours overlap."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    def __init__(self, seed: int = 10) -> None:
        rng = np.random.default_rng(seed)
        new = lambda *shape: rng.normal(0, shape[-2] ** -0.5 if len(shape) > 1 else 0.3, shape).astype(np.float32)
        self.p = {
            "word": np.zeros((1, EMBED), np.float32), "gram": np.zeros((1, EMBED), np.float32),
            "wx": new(2, 2 * EMBED, 3 * HIDDEN), "u": new(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "wa": new(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": new(ATTEND), "wo": new(2 * HIDDEN), "bo": np.zeros(1, np.float32),
        }
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self.slope, self.shift, self.constant = 1.0, 0.0, None

    def learn_vocabulary(self, texts: list[list[str]], rng: np.random.Generator) -> None:
        """Row 0 of either table is what is unknown, and stays zero."""
        for own, table, parts in ((self.words, "word", lambda w: (w,)), (self.grams, "gram", grams_of)):
            seen: dict[str, int] = {}
            for t in texts:
                for x in {x for w in set(t) for x in parts(w)}:
                    seen[x] = seen.get(x, 0) + 1
            own.update((x, k) for k, x in enumerate(sorted(x for x, n in seen.items() if n >= LEAST_TEXTS), 1))
            self.p[table] = rng.normal(0, 0.1, (len(own) + 1, EMBED)).astype(np.float32)
            self.p[table][0] = 0

    def marked(self, texts: list[list[str]], y: np.ndarray, words: list[str]) -> np.ndarray:
        """Which of the words are, or hold a 4-gram, at least ODDS times as frequent in toxic texts; False for no word."""
        out = np.zeros(len(words) + 1, bool)
        for own, parts in ((self.words, lambda w: (w,)), (self.grams, grams_of)):
            seen = np.zeros((2, len(own) + 1))
            for t, label in zip(texts, y, strict=True):
                seen[int(label), list({own.get(x, 0) for w in set(t) for x in parts(w)})] += 1
            n0, n1 = max(1, (y == 0).sum()), max(1, (y > 0).sum())
            every = seen.sum(0)
            ratio = 2 * (seen[1] * np.log(np.maximum(seen[1], 1e-9) * (n0 + n1) / np.maximum(every * n1, 1e-9)) + seen[0] * np.log(np.maximum(seen[0], 1e-9) * (n0 + n1) / np.maximum(every * n0, 1e-9)))
            often = (ratio >= max(RATIO, n1 / 20)) & (seen[1] / n1 >= ODDS * (seen[0] + 0.5) / n0)
            often[0] = False
            out[:-1] |= [any(often[own.get(x, 0)] for x in parts(w)) for w in words]
        return out

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of some words, and what they come from: word rows, gram rows and the word of each gram."""
        known, part = self.words.get, self.grams.get
        rows = np.array([known(w, 0) for w in words], np.int64)
        grams = [[g for g in map(part, grams_of(w)) if g is not None] for w in words]
        sizes = np.array([len(g) for g in grams], np.int64)
        owner, flat = np.repeat(np.arange(len(words)), sizes), np.array([g for own in grams for g in own], np.int64)
        out = np.zeros((len(words), 2 * EMBED), np.float32)
        out[:, :EMBED] = self.p["word"][rows]
        some = np.flatnonzero(sizes)
        if some.size:
            out[some, EMBED:] = np.add.reduceat(self.p["gram"][flat], (np.cumsum(sizes) - sizes)[some])
        return out, rows, flat, owner

    def project(self, x: np.ndarray) -> np.ndarray:
        """The words' share of the gates: direction, word, gate. The last row is the one of no word."""
        both = x @ self.p["wx"] + self.p["b"]
        return np.concatenate([both, np.zeros((2, 1, both.shape[2]), np.float32)], axis=1)

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict | None]:
        """Logits of windows (rows of ids into gates, -1 for no word)."""
        n, length = ids.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((length, 2, n, HIDDEN), np.float32)  # at the step of each direction
        u, saved = self.p["u"], []
        full = bool((ids >= 0).all()) and not keep
        mask = np.ascontiguousarray((ids >= 0).T, np.float32)
        own = np.ascontiguousarray(ids.T)
        for s in range(length):
            x = np.stack([gates[0].take(own[s], 0, mode="wrap"), gates[1].take(own[length - 1 - s], 0, mode="wrap")])
            a = h @ u
            zr = x[:, :, : 2 * HIDDEN] + a[:, :, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            c = r * a[:, :, 2 * HIDDEN :]
            c += x[:, :, 2 * HIDDEN :]
            np.tanh(c, out=c)
            if full:
                h = c + z * (h - c)
            else:
                before, m = h, np.stack([mask[s], mask[length - 1 - s]])[:, :, None]
                h = h + m * (1 - z) * (c - h)
                if keep:
                    saved.append((before, z, r, c, a[:, :, 2 * HIDDEN :], m))
            states[s] = h
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # word, window, both directions
        t = np.tanh(both @ self.p["wa"] + self.p["ba"])
        e = t @ self.p["va"] + np.where(mask > 0, 0, -1e4).astype(np.float32)
        e = np.exp(e - e.max(0))
        share = e / e.sum(0)
        pooled = np.einsum("tn,tnd->nd", share, both)
        return pooled @ self.p["wo"] + self.p["bo"], {"saved": saved, "both": both, "t": t, "share": share, "pooled": pooled} if keep else None

    def backward(self, d: np.ndarray, ids: np.ndarray, gates: np.ndarray, kept: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the gates, and of the gates."""
        p, both, t, share = self.p, kept["both"], kept["t"], kept["share"]
        g = {"bo": d.sum(keepdims=True), "wo": kept["pooled"].T @ d}
        d_pooled = d[:, None] * p["wo"]
        d_both = share[:, :, None] * d_pooled
        d_share = np.einsum("tnd,nd->tn", both, d_pooled)
        d_e = share * (d_share - (share * d_share).sum(0))
        g["va"] = np.einsum("tn,tna->a", d_e, t)
        d_t = d_e[:, :, None] * p["va"] * (1 - t**2)
        g["ba"] = d_t.sum((0, 1))
        g["wa"] = np.tensordot(both, d_t, ((0, 1), (0, 1)))
        d_both += d_t @ p["wa"].T
        length = ids.shape[1]
        g["u"] = np.zeros_like(p["u"])
        d_gates = np.zeros_like(gates)
        carry = np.zeros((2, ids.shape[0], HIDDEN), np.float32)
        u_back = p["u"].transpose(0, 2, 1)
        for s in range(length - 1, -1, -1):
            h, z, r, c, a, m = kept["saved"][s]
            dh = carry + np.stack([d_both[s, :, :HIDDEN], d_both[length - 1 - s, :, HIDDEN:]])
            dm = dh * m
            d_c = dm * (1 - z) * (1 - c**2)
            d_z = dm * (h - c) * z * (1 - z)
            d_r = d_c * a * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_c * r], axis=2)
            g["u"] += h.transpose(0, 2, 1) @ d_a
            carry = dh - dm * (1 - z) + d_a @ u_back
            d_x = np.concatenate([d_z, d_r, d_c], axis=2)
            np.add.at(d_gates[0], ids[:, s], d_x[0])
            np.add.at(d_gates[1], ids[:, length - 1 - s], d_x[1])
        return g, d_gates[:, :-1]

    def train_batch(self, words: list[str], ids: np.ndarray, y: np.ndarray, weight: np.ndarray, moments: dict, step: int) -> None:
        used, at = np.unique(ids[ids >= 0], return_inverse=True)
        local = np.full(ids.shape, -1, np.int64)
        local[ids >= 0] = at
        x, rows, flat, owner = self.inputs([words[k] for k in used])
        gates = self.project(x)
        logits, kept = self.forward(gates, local, keep=True)
        d = ((sigmoid(logits) - y) * weight / weight.sum()).astype(np.float32)
        g, d_gates = self.backward(d, local, gates, kept)
        g["b"] = d_gates.sum(1, keepdims=True)
        g["wx"] = x.T @ d_gates
        d_x = (d_gates @ self.p["wx"].transpose(0, 2, 1)).sum(0)
        for name, index, part in (("word", rows, d_x[:, :EMBED]), ("gram", flat, d_x[:, EMBED:][owner])):
            touched, back = np.unique(index, return_inverse=True)
            total = np.zeros((len(touched), EMBED), np.float32)
            np.add.at(total, back, part)
            total[touched == 0] = 0
            g[name] = (touched, total)
        for name, grad in g.items():
            first, second = moments[name]
            where = slice(None)
            if isinstance(grad, tuple):
                where, grad = grad
            first[where] = 0.9 * first[where] + 0.1 * grad
            second[where] = 0.999 * second[where] + 0.001 * grad**2
            if name in ("word", "gram"):
                self.p[name][where] *= 1 - DECAY
            self.p[name][where] -= RATE * (first[where] / (1 - 0.9**step)) / (np.sqrt(second[where] / (1 - 0.999**step)) + 1e-7)

    def logits_of(self, texts: list[list[str]], cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of some texts, and the text of each."""
        cache = {} if cache is None else cache
        if not cache or len(cache["ids"]) > HELD:
            cache |= {"ids": {}, "gates": np.zeros((2, 1, 3 * HIDDEN), np.float32)}
        ids = cache["ids"]
        known = len(ids)
        flat = []
        for t in texts:
            flat.append(np.array([ids.setdefault(w, len(ids)) for w in t], np.int32))
        if len(ids) > known:
            fresh = self.project(self.inputs(list(ids)[known:])[0])
            cache["gates"] = np.concatenate([cache["gates"][:, :-1], fresh], axis=1)
        owner, rows = [], []
        for k, own in enumerate(flat):
            starts = np.array(windows_of(len(own)))
            at = starts[:, None] + np.arange(WINDOW)
            rows.append(np.where(at < len(own), own[np.minimum(at, max(0, len(own) - 1))], -1) if len(own) else np.full((1, WINDOW), -1))
            owner.append(np.full(len(starts), k))
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        out = np.empty(len(rows), np.float32)
        whole = rows[:, -1] >= 0
        for some in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for a in range(0, len(some), SCORED):
                out[some[a : a + SCORED]] = self.forward(cache["gates"], rows[some[a : a + SCORED]])[0]
        return out, owner

    def best(self, texts: list[list[str]], cache: dict | None = None) -> np.ndarray:
        """The highest window logit of each text."""
        logits, owner = self.logits_of(texts, cache)
        return np.maximum.reduceat(logits, np.searchsorted(owner, np.arange(len(texts)))).astype(np.float64)

    def scores(self, texts: list[str | None], cache: dict | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.slope * self.best([words_of(t) for t in texts], cache) + self.shift)

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 10) -> Network:
        if not len(y) or y.min() == y.max():
            self.constant = float(np.average(y, weights=weight)) if len(y) else 0.0
            return self
        rng = np.random.default_rng(seed)
        split = [words_of(t) for t in texts]
        vocabulary: dict[str, int] = {}
        self.learn_vocabulary(split, rng)
        rows, owner = [], []
        for k, t in enumerate(split):
            starts = np.array(windows_of(len(t)))
            own = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t], np.int64)
            at = starts[:, None] + np.arange(WINDOW)
            rows.append(np.where(at < len(own), own[np.minimum(at, max(0, len(own) - 1))], -1) if len(own) else np.full((1, WINDOW), -1))
            owner.append(np.full(len(starts), k))
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        words, target = list(vocabulary), y[owner].astype(np.float32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, taken = 0, (target == 0) | self.marked(split, y, words)[rows].any(1)
        least = max(1, 60 * BATCH // max(1, len(rows)))  # small samples are seen more often
        for turn in range(ROUNDS):
            weight_of = taken * np.where(target > 0, 0.5 / max(1, taken[target > 0].sum()), 0.5 / max(1, (target == 0).sum()))
            if turn:
                gates = self.project(self.inputs(words)[0])
                logits = np.concatenate([self.forward(gates, rows[a : a + SCORED])[0] for a in range(0, len(rows), SCORED)])
                top = logits >= np.maximum.reduceat(logits, np.searchsorted(owner, np.arange(len(split))))[owner]
                none = np.bincount(owner, taken, len(split))[owner] == 0
                taken |= none & top
                part = np.where(top, np.float32(HARD), 1.0) * taken
                weight_of = part * np.where(target > 0, 0.5 / part[target > 0].sum(), 0.5 / part[target == 0].sum())
            for _ in range(least):
                order = rng.permutation(np.flatnonzero(taken))
                for a in range(0, len(order), BATCH):
                    step += 1
                    at = order[a : a + BATCH]
                    self.train_batch(words, rows[at], target[at], weight_of[at], moments, step)
        raw = np.concatenate([self.best(split[a : a + 64]) for a in range(0, len(split), 64)])
        self.slope, self.shift = calibrated(raw, y, weight)
        return self


def calibrated(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, slightly held towards slope 1."""
    w = weight / weight.sum()
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * raw + shift)
        d, s = (p - y) * w, p * (1 - p) * w + 1e-9
        g = np.array([(d * raw).sum() + 1e-3 * (slope - 1), d.sum()])
        h = np.array([[(s * raw * raw).sum() + 1e-3, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        slope, shift = slope - float(np.clip(move[0], -0.5, 0.5)), shift - float(np.clip(move[1], -2, 2))
    return max(slope, 1e-3), shift


def fit(docs: DataFrame, labels: DataFrame, name: str = "toxic", modulus: int = 5, held_out: int = 0, per_label: int = 1000, sample_bytes: int = 1 << 26) -> Network:
    """The network for labels.name, from ids whose remainder isn't `held_out`. The texts that reach the driver are bounded
    by per_label and sample_bytes."""
    rows = labelled_sample(docs.select("doc_id", "text"), labels, name, modulus, held_out, per_label, sample_bytes, seed=10).toPandas().sort_values("doc_id", kind="stable")
    with one_blas_thread():
        return Network().fit(rows["text"].tolist(), rows["label"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64))


def score(docs: DataFrame, network: Network, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with `out`, the probability of label 1."""

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        with one_blas_thread():
            yield from by_parts(lambda part: pd.Series(network.scores(list(part), cache)), 32)(parts)

    return docs.withColumn(out, probability(F.col(text_col)))
