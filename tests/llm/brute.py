"""Plain versions of the operators, for comparison on small inputs."""

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import xxhash

from pagewright.llm import html_extract

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, most=4):
    fps = np.array(fps, np.uint64)
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= most) + i + 1:
            up[root(i)] = root(int(j))
    low = {}
    for i in range(len(ids)):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return [low[root(i)] for i in range(len(ids))]


def repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)  # noqa: B905
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[k]
            if fits:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def disclosing(texts, near=8, left_bits=1.0, least_share=0.5):
    """(term: bits) by the formulas, from the different texts."""
    texts = sorted({t for t in texts if t is not None})
    kinds, held, by, pairs = ("email", "ip", "card", "phone"), Counter(), Counter(), Counter()
    for text in texts:
        base, words = base_spans(text), [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
        held.update({text[a:b].lower() for a, b in words})
        free = [(a, b) for a, b in words if not any(x < b and a < y for x, _, y in base)]
        met, entities = set(), set()
        for x, k, y in base:
            e = (kinds[k], text[x:y].lower() if k < 2 else re.sub("[^0-9]", "", text[x:y]))
            entities.add(e)
            met |= {(e, text[a:b].lower()) for a, b in [w for w in free if w[1] <= x][-near:] + [w for w in free if w[0] >= y][:near]}
        by.update(entities)
        pairs.update(met)
    out = {}
    for (e, t), n in pairs.items():
        p, p_e = n / (held[t] + 1), by[e] / len(texts)
        pmi, ic = np.log2(p / p_e), -np.log2(p_e)
        if -np.log2(p) <= left_bits and pmi > 0 and pmi >= least_share * ic:
            out[t] = min(out.get(t, 99), -np.log2(p))
    return out


class Blocks(HTMLParser):
    """Blocks of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.skipped, self.parts, self.links, self.heading = [], [], [], [], 0, False

    def close_block(self):
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            total = sum(len(p) for p, _ in self.parts)
            aside, article = self.stack[-1][1:] if self.stack else (False, False)
            self.out.append((text, sum(len(p) for p, linked in self.parts if linked) / total, aside, article, self.heading))
        self.parts = []

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append((data, self.links > 0))

    def handle_startendtag(self, name, attrs):
        if name == "br" and not self.skipped:
            self.parts.append((" ", False))
        elif name in html_extract.BLOCK_TAGS and not self.skipped:
            self.close_block()
            self.links = 0

    def handle_starttag(self, name, attrs):
        if name in html_extract.VOID:
            return self.handle_startendtag(name, attrs)
        if name in html_extract.SKIPPED:
            return self.skipped.append(name)
        if self.skipped:
            return None
        if name == "a":
            self.links += 1
            return None
        if name in html_extract.BLOCK_TAGS:
            self.close_block()
            self.links, self.heading = 0, name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if self.stack and self.stack[-1][0] == name and name in ("p", "li", "dt", "dd"):
                self.stack.pop()
        above = self.stack[-1] if self.stack else ("", False, False)
        raw = re.match(r"<[^\s/>]+(.*)>$", self.get_starttag_text(), re.S)[1]
        aside = above[1] or html_extract._aside(name, raw, above[2])
        if name in html_extract.BLOCK_TAGS:
            self.stack.append((name, aside, above[2] or name in ("article", "main")))
        elif aside != above[1]:
            self.close_block()
            self.stack.append((name, aside, above[2]))
        return None

    def handle_endtag(self, name):
        if name in self.skipped:
            del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(name) :]
        elif self.skipped:
            return
        elif name == "a":
            self.links = max(0, self.links - 1)
        else:
            names = [s[0] for s in self.stack]
            if name in names:
                self.close_block()
                del self.stack[len(names) - 1 - names[::-1].index(name) :]
            if name in html_extract.BLOCK_TAGS:
                self.close_block()
                self.heading = False


def blocks(page):
    parser = Blocks()
    parser.feed(page or "")
    parser.close()
    parser.close_block()
    return parser.out
