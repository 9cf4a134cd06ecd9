"""Buckets whose windows are told apart by hashes: results against plain counts, and how much memory they take."""

import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import suffix_dedup


def plain(runs, length):
    seen = Counter(r[i : i + length] for r in runs for i in range(len(r) - length + 1))
    out = []
    for k, r in enumerate(runs):
        begin = None
        for i in range(len(r) - length + 2):
            hit = i <= len(r) - length and seen[r[i : i + length]] > 1
            if hit and begin is None:
                begin = i
            if not hit and begin is not None:
                out.append((k, begin, i - 1 + length))
                begin = None
    return out


@pytest.mark.parametrize(("gathered", "block"), [(1 << 20, 1 << 19), (7, 1 << 19), (50, 13), (1, 5)])
def test_spans_by_hashes(monkeypatch, gathered, block):
    monkeypatch.setattr(suffix_dedup, "GATHERED", gathered)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 64)
    r, length = random.Random(gathered), 8
    hasher = suffix_dedup.Hasher(1000)
    for _ in range(60):
        unit = bytes(r.choices(b"ab", k=r.randint(1, 5)))
        runs = [(unit * 40)[: r.randint(length, 60)] + bytes(r.choices(b"abc", k=r.randint(0, 30))) for _ in range(r.randint(1, 6))]
        assert suffix_dedup.spans_by_hashes(runs, length, hasher) == plain(runs, length)


def test_strings_of_one_hash(monkeypatch):
    """A hash that takes few values: strings are still told apart."""

    class Poor(suffix_dedup.Hasher):
        def rolling(self, data, width):
            return super().rolling(data, width) % np.uint64(3) << np.uint64(32)

    monkeypatch.setattr(suffix_dedup, "GATHERED", 20)
    r = random.Random(5)
    for _ in range(40):
        runs = [bytes(r.choices(b"ab", k=r.randint(6, 40))) for _ in range(r.randint(1, 5))]
        assert suffix_dedup.spans_by_hashes(runs, 6, Poor(1000)) == plain(runs, 6)


MEASURE = """
import random, resource, sys
from pagewright.llm import suffix_dedup
r = random.Random(1)
kind, length = sys.argv[1], 400
if kind == "near":
    runs = [b"".join(bytes(r.choices(b"abcdefgh", k=90)) * 6 for _ in range(500_000 // 540)) for _ in range(63)]
else:
    runs = [b"ab" * 250_000] * 63
hasher = suffix_dedup.Hasher(suffix_dedup.BLOCK + length)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
suffix_dedup.spans_by_hashes(runs, length, hasher)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("kind", ["near", "one string"])
def test_a_full_bucket_takes_bounded_memory(kind):
    """63 runs of half a MB, just below what one task gathers, of texts that repeat at short distance."""
    done = subprocess.run([sys.executable, "-c", MEASURE, kind], capture_output=True, text=True, timeout=300, cwd=str(__import__("pathlib").Path(suffix_dedup.__file__).parents[2]))
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 300
