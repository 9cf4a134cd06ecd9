"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token bucket has a fixed index vector: DIMS numbers of which NONZERO are +1 or -1, by a seed. A bucket's word
vector is the sum of the index vectors of its neighbours, over all documents, scaled to length 1. A document's input
is the mean and the deviation of its tokens' vectors. The network has one hidden layer and is trained in numpy on a
sample of at most about `per_label` labelled documents (default 3000) and `sample_bytes` bytes of each label, weighted back to the labels'
shares; a temperature fitted on a fifth of the sample calibrates its probabilities.

Tokens are runs of letters (case matters), digits or other marks; a token equal to the one before it counts as the
token REPEAT. Buckets are hashes, so the vectors have one size for any vocabulary: tasks sum them up and send at most
BUCKETS rows each.

Defined cases: a null, empty or white text has zero input and gets the score the network gives to that. Without any
labelled row every score is 0.5; with one label only, scores tend to it. Repeated rows get equal scores. Texts are read
whole. An empty table gives an empty result. Other columns pass through; a column named like the output is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import by_parts, labelled_sample, one_blas_thread, parts_of

BUCKETS, DIMS, NONZERO, REPEAT = 1 << 14, 32, 4, 0
HIDDEN, STEPS = 16, 400
TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
#: Tokens per numpy block; words whose bucket a task remembers.
BLOCK, HELD = 1 << 18, 300_000


class Buckets(dict):
    """Token to bucket."""

    def __missing__(self, token: str) -> int:
        if len(self) > HELD:
            self.clear()
        self[token] = b = zlib.crc32(token.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1
        return b


def token_ids(text: str | None, buckets: Buckets) -> np.ndarray:
    ids = np.array(list(map(buckets.__getitem__, TOKEN.findall(text or ""))), np.int32)
    again = np.flatnonzero(ids[1:] == ids[:-1]) + 1
    ids[again] = REPEAT
    return ids


def index_vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO].astype(np.int32)
    return at, rng.choice(np.array([-1, 1], np.int32), (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS by DIMS: the buckets' context sums over all docs, scaled to length 1. What reaches the driver has
    that size for any input."""
    names = [f"v{k}" for k in range(DIMS)]

    def run(batches):
        at, sign = index_vectors()
        sums, buckets = np.zeros(BUCKETS * DIMS, np.int64), Buckets()

        def add(parts: list[np.ndarray]) -> None:
            ids = np.concatenate(parts)
            last = np.cumsum([len(p) for p in parts])[:-1] - 1
            pair = np.ones(len(ids), bool)
            pair[last] = False
            pair[-1] = False
            a, b = ids[:-1][pair[:-1]], ids[1:][pair[:-1]]
            for x, y in ((a, b), (b, a)):
                for k in range(NONZERO):
                    sums[:] += np.bincount(x * DIMS + at[y, k], sign[y, k], BUCKETS * DIMS).astype(np.int64)

        parts, size = [], 0
        for batch in parts_of(batches):
            for text in batch.column(0).to_pylist():
                ids = token_ids(text, buckets)
                if len(ids) > 1:
                    parts.append(ids)
                    size += len(ids)
                if size > BLOCK:
                    add(parts)
                    parts, size = [], 0
        if parts:
            add(parts)
        table = sums.reshape(BUCKETS, DIMS)
        there = np.flatnonzero(table.any(1))
        if there.size:
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(table[there, k]) for k in range(DIMS))], names=["bucket", *names])

    sums = docs.select(text_col).mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    rows = sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    if len(rows):
        raw = rows[names].to_numpy(np.float64)
        vectors[rows["bucket"].to_numpy()] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return vectors


def pooled(texts: list[str | None], vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """Mean and deviation of each text's token vectors."""
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    for k, text in enumerate(texts):
        ids = token_ids(text, buckets)
        total, square = np.zeros(DIMS), np.zeros(DIMS)
        for a in range(0, len(ids), BLOCK):
            v = vectors[ids[a : a + BLOCK]]
            total += v.sum(0, dtype=np.float64)
            square += np.einsum("ij,ij->j", v, v)
        if len(ids):
            mean = total / len(ids)
            out[k, :DIMS] = mean
            out[k, DIMS:] = np.sqrt(np.maximum(square / len(ids) - mean**2, 0))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """inputs -> HIDDEN tanh -> one logit, over a temperature."""

    def __init__(self) -> None:
        self.shift = self.scale = None
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parts
        return np.tanh((x - self.shift) / self.scale @ w + b) @ v + c

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.shift is None else sigmoid(self.logits(x.astype(np.float64)) / self.temperature)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3) -> Network:
        if not len(x):
            return self
        x = x.astype(np.float64)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        apart, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.shift, self.scale = x[own].mean(0), x[own].std(0) + 1e-6
        inputs, wide = (x[own] - self.shift) / self.scale, x.shape[1]
        self.parts = [rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        share = weight[own] / weight[own].sum()
        for step in range(1, STEPS + 1):
            w, b, v, c = self.parts
            h = np.tanh(inputs @ w + b)
            d = (sigmoid(h @ v + c) - y[own]) * share
            back = np.outer(d, v) * (1 - h**2)
            for k, g in enumerate((inputs.T @ back + 1e-4 * w, back.sum(0), h.T @ d + 1e-4 * v, d.sum())):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.parts[k] = self.parts[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if len(apart):
            raw, grid = self.logits(x[apart]), np.geomspace(0.25, 8, 61)
            cost = [(weight[apart] * np.logaddexp(0, np.where(y[apart] > 0, -raw, raw) / t)).sum() for t in grid]
            self.temperature = float(grid[int(np.argmin(cost))])
        return self


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, name: str = "quality", modulus: int = 3, held_out: int = 1, per_label: int = 3000, sample_bytes: int = 1 << 30) -> Network:
    """The network for labels.name, from ids whose remainder isn't `held_out`. Only pooled vectors reach the driver."""

    @F.pandas_udf("array<float>")
    def pool(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        yield from by_parts(lambda part: pd.Series(list(pooled(list(part), vectors, buckets))))(parts)

    rows = labelled_sample(docs.select("doc_id", "text"), labels, name, modulus, held_out, per_label, sample_bytes, seed=3)
    rows = rows.select("doc_id", pool("text").alias("x"), "label", "weight").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), 2 * DIMS)
    with one_blas_thread():
        return Network().fit(x, rows["label"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with `out`, the probability of label 1."""

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        with one_blas_thread():
            yield from by_parts(lambda part: pd.Series(network.scores(pooled(list(part), vectors, buckets))))(parts)

    return docs.withColumn(out, probability(F.col(text_col)))
