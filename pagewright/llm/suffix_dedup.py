"""Exact substring dedup by blockwise sorting of suffixes, one bucket at a time.

Removed is each byte that is covered by a string of LENGTH bytes which also starts anywhere else. Two positions
matter to each other only if their suffixes agree on LENGTH bytes, so suffixes are dealt into buckets that agreeing
ones share, and sorted bucket by bucket.

The cover. A difference cover picks positions by their remainders, so that any two suffixes have sampled positions at
some equal distance, whose ranks settle long ties. Here the cover is picked by content: of the KEY-byte strings inside
a window of LENGTH bytes, the one with the least hash, of several equal ones the first. Equal windows pick equal
strings at equal distances, so that string's hash is the bucket of every suffix that picks it, and a bucket that only
one position of the corpus is in has no tie. That needs about 0.7 % of all positions as the sample; a difference cover
of period 183 (14 remainders, the fewest possible) needs 7.7 %. The README has the reasons and figures.

Steps
1. Texts are taken once each, by their md5. Of a text that occurs twice, everything is removed (if it is long enough).
2. A text's windows form runs that share a sampled position. (bucket, text, start) of all runs is aggregated by bucket;
   buckets with one run only are dropped, unless the bucket's string occurs in it again (text that repeats at short
   distance).
3. Runs of the other buckets are sent there with their bytes (about half of the input's size or less), and each bucket
   is worked through by itself. Runs with equal bytes are ties that need no comparison. Of the others the suffixes at
   the sampled positions are sorted, which gives these ranks and the lengths that neighbours share; so are the bytes
   before them, read backwards. A suffix that starts d bytes before its sample repeats if another one of the bucket has
   an equal rank before the sample, as far as d bytes go, and an equal rank after it, as far as LENGTH - d bytes go. So
   ties of any length are settled by ranks that were computed once, and no suffix is compared byte by byte.
4. In a bucket with runs in which its string occurs again, windows have no single sample; they are sorted by hashes, and
   equal hashes count only if the bytes are equal, too. A bucket of more than HOT runs or HOT_BYTES bytes isn't gathered:
   its runs, cut so that a piece's windows share their first sample, are sorted over all tasks, neighbours are settled by
   ranks, and of each kind of window one from each chunk of neighbours is dealt by its md5.
5. Repeating windows become spans, per text, and these are cut from it.

Results depend on no 64-bit hash; texts, and windows of the largest buckets, are told apart by their md5.

Defined cases: a null text is an empty one; texts shorter than LENGTH bytes are left whole. Repeated rows are copies
of each other. Texts of any length are worked through in blocks. An empty table gives an empty result. Other columns
pass through; columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import HOT_SHARE, cut, parts_of

LENGTH, KEY = 400, 128
#: Windows per block of a long text; the most runs and bytes of a bucket that one task gathers.
BLOCK, HOT, HOT_BYTES = 1 << 19, 20_000, 1 << 25
#: Pieces of a larger bucket that are settled together.
CHUNK = 4096
#: Ranks, and bytes of windows with equal hashes, that are compared at once.
TOGETHER = 1 << 20
#: Windows whose hashes are held at once.
GATHERED = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
OUTPUTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


class Hasher:
    """64-bit hashes of all stretches of some width: sums of bytes times powers, modulo 2**64, then mixed."""

    def __init__(self, most: int) -> None:
        self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(most, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64)))

    def rolling(self, data: np.ndarray, width: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * self.down[: len(data) - width + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from running minima of blocks of w in both directions."""
    n = len(x) - w + 1
    y = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    y[: len(x)] = x
    blocks = y.reshape(-1, w)
    to_right = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    to_left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(to_left[:n], to_right[w - 1 : w - 1 + n])


def runs(data: np.ndarray, hasher: Hasher, length: int = LENGTH, key: int = KEY):
    """(buckets, first windows, numbers of windows, whether the bucket's string occurs again within the run, so that its windows have
    several samples, hashes from the block's first byte, that byte's place) of the runs of data's windows, block by block."""
    for low in range(0, len(data) - length + 1, BLOCK):
        block = data[low : low + BLOCK + length - 1]
        hashes = hasher.rolling(block, key)
        bucket = sliding_min(hashes, length - key + 1)
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[start, len(bucket)])
        leaves = hashes[: len(bucket)] == bucket  # the string is left behind with this window
        again = np.add.reduceat(leaves, start, dtype=np.int64) - leaves[start + size - 1] > 0
        yield bucket[start].view(np.int64), start + low, size, again, hashes, low


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def all_runs(texts: DataFrame, length: int, key: int) -> DataFrame:
    """(bucket, text key as two longs, start, bytes, again) of every run of the column `text`."""

    def work(batches):
        hasher = Hasher(BLOCK + length)
        for batch in parts_of(batches):
            keys, found = batch.column(0).to_pylist(), []
            for k, text in zip(keys, batch.column(1).to_pylist(), strict=True):
                for bucket, start, size, again, _, _ in runs(bytes_of(text), hasher, length, key):
                    found.append((np.frombuffer(k, ">i8"), bucket, start, size, again))
            if found:
                repeat = [len(f[1]) for f in found]
                k1, k2 = (np.repeat([f[0][i] for f in found], repeat).astype(np.int64) for i in (0, 1))
                bucket, start, size, again = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3, 4))
                columns = (bucket, k1, k2, start.astype(np.int64), (size + length - 1).astype(np.int32), again)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "k1", "k2", "start", "bytes", "again"])

    return texts.select("key", "text").mapInArrow(work, "bucket long, k1 long, k2 long, start long, bytes int, again boolean")


def with_bytes(texts: DataFrame, length: int, key: int) -> DataFrame:
    """For rows (key, text, wanted: array of (start, hot)): bucket, key, start, at, hot and the bytes of each wanted run; `at`
    is its sample's distance from the start."""
    names, kinds = ["bucket", "key", "start", "at", "hot", "bytes"], (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())

    def work(batches):
        hasher = Hasher(BLOCK + length)
        for batch in parts_of(batches):
            out: list[list] = [[] for _ in names]
            for k, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = bytes_of(text)
                raw, want = data.tobytes(), {w["start"]: w["hot"] for w in wanted}
                wanted_starts = np.fromiter(want, np.int64, len(want))
                for bucket, start, size, again, hashes, low in runs(data, hasher, length, key):
                    for r in np.flatnonzero(np.isin(start, wanted_starts)).tolist():
                        b, s, n = int(bucket[r]), int(start[r]), int(size[r])
                        # all windows of the run hold its sample: the first place from the last window on that has the bucket's hash
                        last = s + n - 1 - low
                        d = -1 if again[r] else n - 1 + int(np.argmax(hashes[last : last + length - key + 1] == hashes.dtype.type(b % (1 << 64))))
                        for column, x in zip(out, (b, k, s, d, want[s], raw[s : s + n + length - 1]), strict=True):
                            column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return texts.select("key", "text", "wanted").mapInArrow(work, "bucket long, key binary, start long, at int, hot boolean, bytes binary")


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share at their start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def ranked(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The places of some strings in sorted order, and for each place what its string shares with the one before it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.array([0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))])  # noqa: B905


def ties(before: list[bytes], after: list[bytes], reach_before: np.ndarray, reach_after: np.ndarray, length: int):
    """For steps of distances: the first of them, and by distance and run whether the window so many bytes before the sample is another run's,
    too, and whether it is the first of its kind. Windows beyond what a run is said to reach are left out."""
    (rank_before, share_before), (rank_after, share_after) = ranked(before), ranked(after)
    m, most = len(before), int(reach_before.max())
    step = max(1, TOGETHER // m)
    for low in range(0, most + 1, step):
        d = np.arange(low, min(low + step, most + 1))[:, None]
        # equal where two neighbours share enough; a class is the number of borders up to the rank
        left = np.cumsum(share_before < d, axis=1)[:, rank_before]
        right = np.cumsum(share_after < length - d, axis=1)[:, rank_after]
        code = left * (m + 1) + right
        code = np.where((reach_before >= d) & (reach_after >= length - d), code, -1 - np.arange(m))
        order = np.argsort(code, axis=1)
        there = np.take_along_axis(code, order, 1)
        equal = np.zeros((len(d), m + 1), bool)
        equal[:, 1:m] = there[:, 1:] == there[:, :-1]
        tied, first = np.zeros(code.shape, bool), np.zeros(code.shape, bool)
        np.put_along_axis(tied, order, equal[:, 1:] | equal[:, :-1], 1)
        np.put_along_axis(first, order, ~equal[:, :-1] & (there >= 0), 1)
        yield low, tied, first


def stretches(tied: np.ndarray) -> list[tuple[int, int, int]]:
    """(run, least, largest distance) of stretches in which a run's windows are tied."""
    edges = np.diff(np.pad(tied, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (run, first), (_, last) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    return list(zip(run.tolist(), first.tolist(), (last - 1).tolist(), strict=True))


def spans_by_ranks(runs: list[tuple[bytes, int]], length: int) -> list[tuple[int, int, int]]:
    """(run, low, high) of the bytes covered by windows that repeat among the runs (bytes, distance of the sample) of one
    bucket, which have different bytes."""
    if len(runs) < 2:
        return []
    before, after = [d[:at][::-1] for d, at in runs], [d[at:] for d, at in runs]
    if len(runs) == 2:
        left, right = common(*before), common(*after)
        return [(k, at - left, at + right) for k, (_, at) in enumerate(runs)] if left + right >= length else []
    parts = ties(before, after, np.array([len(x) for x in before]), np.array([len(x) for x in after]), length)
    tied = np.concatenate([tied for _, tied, _ in parts]).T
    return [(k, runs[k][1] - far, runs[k][1] - near + length) for k, near, far in stretches(tied)]


def spans_by_hashes(runs: list[bytes], length: int, hasher: Hasher) -> list[tuple[int, int, int]]:
    """The same for runs whose windows have several samples: windows with equal hashes are compared byte by byte. Windows are worked through by
    parts of the hashes' range, about GATHERED of them at a time, for which all runs are hashed again; of windows that are equal one stays
    to be compared, so a string that fills a part needs no more room than others."""
    data = np.frombuffer(b"".join(runs), np.uint8)
    sizes = np.array([len(r) for r in runs])
    begins = np.cumsum(sizes) - sizes
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    tied = np.zeros(len(data), bool)  # by the window's first byte
    parts = -(-int((sizes - length + 1).sum()) // GATHERED)
    for part in range(parts):
        held, places, n = [], [], 0
        for k, begin in enumerate(begins.tolist()):
            for low in range(0, int(sizes[k]) - length + 1, BLOCK):
                hashes = hasher.rolling(data[begin + low : begin + min(low + BLOCK + length - 1, int(sizes[k]))], length)
                own = np.flatnonzero((hashes >> np.uint64(32)) % np.uint64(parts) == part)
                held.append(hashes[own])
                places.append(own + (begin + low))
                n += len(own)
                if n > 2 * GATHERED:
                    held, places = ([x] for x in told_apart(np.concatenate(held), np.concatenate(places), windows, tied))
                    n = len(held[0])
        told_apart(np.concatenate(held), np.concatenate(places), windows, tied)
    out = []
    for k, begin in enumerate(begins.tolist()):
        edges = np.flatnonzero(np.diff(np.r_[False, tied[begin : begin + sizes[k] - length + 1], False]))
        out += [(k, a, b - 1 + length) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return out


def told_apart(hashes: np.ndarray, places: np.ndarray, windows: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks windows that are equal in `tied`, and returns hash and place of one window for each different string."""
    order = np.argsort(hashes, kind="stable")
    hashes, places = hashes[order], places[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    kept = new.copy()
    others = np.flatnonzero(~new)
    step = max(1, TOGETHER // windows.shape[1])
    for k in range(0, len(others), step):
        x = others[k : k + step]
        same = (windows[places[x]] == windows[places[lead[x]]]).all(1)
        tied[places[x[same]]] = tied[places[lead[x[same]]]] = True
        kept[x[~same]] = True
    for h in np.unique(hashes[kept & ~new]):  # different strings of one hash: told apart by their bytes
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero((hashes == h) & kept).tolist():
            first = seen.setdefault(windows[places[k]].tobytes(), k)
            if first != k:
                tied[places[k]] = tied[places[first]] = True
                kept[k] = False
    return hashes[kept], places[kept]


def span_batch(out: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "low", "high"])


def repeats_in_buckets(found: DataFrame, length: int) -> DataFrame:
    """(key, low, high): bytes covered by windows that repeat, for runs sorted by bucket and bytes. One bucket is held at a
    time."""

    def work(batches):
        hasher, out = Hasher(BLOCK + length), []
        held: list[tuple[bytes, int, bytes, int, bool]] = []  # different bytes of a bucket, sample, one place of them, whether it is the only one
        of = None

        def settle() -> None:
            if any(h[1] < 0 for h in held):
                spans = spans_by_hashes([h[0] for h in held], length, hasher)
            else:
                spans = spans_by_ranks([h[:2] for h in held], length)
            out.extend((held[k][2], held[k][3] + a, held[k][3] + b) for k, a, b in spans if held[k][4])
            held.clear()

        for batch in parts_of(batches):
            for bucket, key, start, at, _, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and bucket == of and held[-1][0] == data:
                    if held[-1][4]:
                        out.append((held[-1][2], held[-1][3], held[-1][3] + len(data)))
                        held[-1] = (*held[-1][:4], False)
                    out.append((key, start, start + len(data)))
                    continue
                if bucket != of:
                    settle()
                    of = bucket
                held.append((data, at, key, start, True))
            if out:
                yield span_batch(out)
                out.clear()
        settle()
        if out:
            yield span_batch(out)

    return found.mapInArrow(work, "key binary, low long, high long")


def pieces(found: DataFrame, length: int, key: int) -> DataFrame:
    """(bucket, key, starts, before, after) of runs: windows that share their first sample, the bytes before it, read backwards, and those from it
    on. Equal pieces of a run are one row with several starts."""
    names, kinds = ["bucket", "key", "starts", "before", "after"], (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())

    def work(batches):
        hasher = Hasher(BLOCK + length)
        for batch in parts_of(batches):
            out: list[list] = [[] for _ in names]
            for bucket, k, start, at, _, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                last, samples, low = len(data) - length, [at], 0
                if at < 0:
                    places = np.flatnonzero(hasher.rolling(np.frombuffer(data, np.uint8), key) == np.uint64(bucket % (1 << 64)))
                    samples = places[: np.searchsorted(places, last) + 1].tolist()
                seen: dict[tuple[bytes, bytes], list[int]] = {}
                for place in samples:
                    seen.setdefault((data[low:place][::-1], data[place : min(place, last) + length]), []).append(start + low)
                    low = place + 1
                for (before, after), starts in seen.items():
                    for column, x in zip(out, (bucket, k, starts, before, after), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return found.mapInArrow(work, "bucket long, key binary, starts array<long>, before binary, after binary")


def with_reach(batches, column: int):
    """Rows sorted by bucket and a column of bytes, each with how much of its bytes it shares with a neighbour, so with any other row of the bucket.
    A neighbour in another partition isn't seen; all may be shared with it."""
    held, share = None, 0
    for batch in parts_of(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None:
                share = len(row[column])
            else:
                own = common(held[column], row[column]) if held[0] == row[0] else 0
                yield held, max(share, own)
                share = own
            held = row
    if held is not None:
        yield held, len(held[column])


def repeats_in_hot_buckets(found: DataFrame, length: int, key: int) -> DataFrame:
    """The same for buckets that are too large to gather. Their pieces are sorted over all tasks, by the bytes before the sample and by those from it
    on, which gives how far a piece's windows can repeat at all. CHUNK neighbours are settled together by ranks. What remains, one window of each
    kind in a chunk, is dealt by its md5 to find its like in other chunks."""
    names = ["bucket", "key", "starts", "before", "after", "reach"]
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())

    def reaching(batches):
        out = []
        for row, reach in with_reach(batches, 3):
            if len(row[2]) > 1 or reach + len(row[4]) >= length:
                out.append((*row, reach))
            if len(out) == CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def settled(chunk: list[tuple]):
        """Rows (key, low, high, bucket, md5): without md5 what repeats; with md5 windows, with key if it isn't known yet whether they repeat."""
        before, after = [r[3] for r in chunk], [r[4] for r in chunk]
        out, parts = [], []
        for low, tied, first in ties(before, after, np.array([r[5] for r in chunk]), np.array([r[6] for r in chunk]), length):
            parts.append(tied)
            for x, k in zip(*(x.tolist() for x in np.nonzero(first)), strict=True):
                d = low + x
                md5 = hashlib.md5(before[k][:d][::-1] + after[k][: length - d], usedforsecurity=False).digest()
                at = chunk[k][2][0] + len(before[k]) - d
                out.append((None if tied[x, k] or len(chunk[k][2]) > 1 else chunk[k][1], at, at + length, chunk[k][0], md5))
        for k, near, far in stretches(np.concatenate(parts).T):
            if len(chunk[k][2]) == 1:
                at = chunk[k][2][0] + len(before[k])
                out.append((chunk[k][1], at - far, at - near + length, chunk[k][0], None))
        return out

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "low", "high", "bucket", "md5"])

    def work(batches):
        chunk: list[tuple] = []
        for row, reach in with_reach(batches, 4):
            if chunk and (len(chunk) == CHUNK or chunk[0][0] != row[0]):
                yield batch_of(settled(chunk))
                chunk = []
            if len(row[2]) > 1:
                yield batch_of([(row[1], a, a + len(row[3]) + len(row[4]), row[0], None) for a in row[2]])
            if row[5] + reach >= length:
                chunk.append((*row, reach))
        if chunk:
            yield batch_of(settled(chunk))

    by = lambda rows, half: rows.repartitionByRange("bucket", half, "key", "starts").sortWithinPartitions("bucket", half)
    reached = by(pieces(found, length, key), "before").mapInArrow(reaching, "bucket long, key binary, starts array<long>, before binary, after binary, reach long")
    rows = cut(by(reached, "after").mapInArrow(work, "key binary, low long, high long, bucket long, md5 binary"))
    windows = rows.where("md5 is not null")
    many = windows.groupBy("bucket", "md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "md5")
    spans = rows.where("md5 is null").unionAll(windows.where("key is not null").join(many, ["bucket", "md5"]).select(*rows.columns))
    return spans.select("key", "low", "high")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut_text(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join(parts) + data[at:]


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, key: int = KEY, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, text, key) of docs; (key, copies, head): how often each text occurs and one id that has it; and (key, head,
    spans) of those texts that occur once and have repeating windows."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("head"), F.first(F.octet_length("text")).alias("bytes"))
    every = cut(all_runs(rows.where(F.octet_length("text") >= length), length, key))
    place = ("k1", "k2", "start")
    ends = [f(c).alias(f"{name}_{c}") for c in place for name, f in (("least", F.min), ("most", F.max))]
    shared = every.groupBy("bucket").agg(*ends, F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("again").alias("again"))
    shared = cut(shared.where(" or ".join(["again", *(f"least_{c} <> most_{c}" for c in place)])).select("bucket", "n", ((F.col("n") > hot) | (F.col("bytes") > HOT_BYTES)).alias("hot")))
    facts = shared.agg(F.sum("n"), F.max("hot")).first()
    # the buckets of more than one in HOT_SHARE of the runs, so fewer than HOT_SHARE, are joined apart
    often = F.col("n") > (facts[0] or 0) / HOT_SHARE
    largest = F.broadcast(shared.where(often).select("bucket", "hot"))
    wanted = every.join(largest, "bucket").unionByName(every.join(largest.select("bucket"), "bucket", "left_anti").join(shared.where(~often).select("bucket", "hot"), "bucket"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "hot")).alias("wanted"))
    key_of = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("k1", "k2")]))
    wanted = wanted.select(key_of.alias("key"), "wanted").join(copies, "key").select("key", "wanted", F.coalesce(F.col("head").cast("string"), F.lit("")).alias("head"))
    texts = rows.select("key", "text", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("head"))
    found = with_bytes(texts.join(wanted, ["key", "head"]), length, key)
    if facts[1]:
        found = cut(found)
        spans = repeats_in_buckets(found.where("not hot").repartition("bucket").sortWithinPartitions("bucket", "bytes"), length)
        spans = spans.unionAll(repeats_in_hot_buckets(found.where("hot"), length, key))
    else:
        spans = repeats_in_buckets(found.repartition("bucket").sortWithinPartitions("bucket", "bytes"), length)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return texts, copies, spans


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, key: int = KEY, hot: int = HOT) -> DataFrame:
    """docs without its text but with n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256."""
    texts, copies, spans = spans_of(docs, id_col, text_col, length, key, hot)

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans, strict=True):
            whole = merged([(int(s["low"]), int(s["high"])) for s in own])
            kept = _cut_text(text.encode("utf-8", "surrogatepass"), whole)
            out.append((sum(b - a for a, b in whole), len(whole), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    once = spans.join(copies.where("copies = 1"), "key").select("key", F.coalesce(F.col("head").cast("string"), F.lit("")).alias("head"), "spans")
    done = texts.join(once, ["key", "head"]).select("key", digest("text", "spans").alias("r")).select("key", "r.*")
    all_of = copies.where((F.col("copies") > 1) & (F.col("bytes") >= length)).select("key", F.col("bytes").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    results = done.unionByName(all_of)
    kept = [c for c in docs.columns if c not in (*OUTPUTS, text_col)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.unhex(F.md5(text.cast("binary"))).alias("__key"), F.octet_length(text).cast("long").alias("__bytes"), F.sha2(text.cast("binary"), 256).alias("__sha"))
    joined = own.join(results.withColumnRenamed("key", "__key"), "__key", "left")
    nothing = F.lit(0).cast("long")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col("__bytes").alias("n_bytes"), F.coalesce("n_removed", nothing).alias("n_removed"), F.coalesce("n_spans", nothing).alias("n_spans"), F.coalesce("kept_sha256", "__sha").alias("kept_sha256"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the repeating bytes cut from the texts. A character that is cut into becomes U+FFFD. Null stays null."""
    _, copies, spans = spans_of(docs, id_col, text_col, **how)
    length = how.get("length", LENGTH)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series, all_of: pd.Series) -> pd.Series:
        out = []
        for text, own, everything in zip(texts, spans, all_of, strict=True):
            if text is not None and everything:
                text = ""
            elif text is not None and own is not None:
                text = _cut_text(text.encode("utf-8", "surrogatepass"), merged([(int(s["low"]), int(s["high"])) for s in own])).decode("utf-8", "replace")
            out.append(text)
        return pd.Series(out, dtype=object)

    facts = copies.join(spans, "key", "left").where((F.col("copies") > 1) | F.col("spans").isNotNull()).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"), ((F.col("copies") > 1) & (F.col("bytes") >= length)).alias("__all"))
    own = docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))).join(facts, "__key", "left")
    made = own.withColumn("__text", kept(F.col(text_col), F.col("__spans"), F.coalesce("__all", F.lit(False))))
    return made.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
