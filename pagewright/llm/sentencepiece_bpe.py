"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A merge-type model starts from single characters and always merges the neighbours whose join is the piece of highest score (of
equal ones the leftmost), until no two neighbours make a piece. A sequence of tokens is that result exactly if each token merges
to itself and each two adjacent tokens, joined and merged anew, give those two again: the first merge across a boundary would
show in the pair as well. So a text is encoded without merging it:

1. Aho-Corasick finds the longest piece that begins at each character; shorter ones follow by a table (the longest proper
   prefix of a piece that is a piece, in the end its first character).
2. From left to right the longest piece is taken that is compatible with the token before it. Compatibility is checked by
   re-merging the two, and remembered.
3. Where none fits, the token before is taken back and the position is marked in a bitfield: the tokens up to a position are
   the encoding of the text up to it, so there is one way only to reach it, and it has failed for good.

Pieces that don't merge to themselves are left out when the tables are made. Characters that no piece has are tokens of one
character; they become byte pieces if the model has them, else the unknown id (one for a run of such characters, as the library has it).

Texts are encoded word by word where that is exact: a boundary between two characters that stand side by side in no piece is
never merged across. The tables tell from the pieces whether that holds before every space, and where Latin letters and other
characters meet; where it doesn't, texts aren't cut there. Ids of at most MEMO_WORDS words and MEMO_RUNS such runs with
fewer than MEMO_CHARS characters are remembered, so memory has a bound; a word of any length is encoded whole, by four bytes and one bit for each
of its characters beside its ids.

The model is a file of the sentencepiece library, read on the driver; its tables, which have the vocabulary's size, are broadcast.
Only models of the merge type whose normaliser changes nothing are taken (others raise ValueError), with or without a space put
in front, as the model says. Decoding joins pieces, turns byte pieces into UTF-8 (bytes that are none give U+FFFD each) and drops that
space. No begin or end ids are put in; control ids decode to nothing, an unknown id to the model's text for it.

Defined cases: a null or empty text has no ids; null ids decode to the empty text, and a null among them counts as none. An id outside
the vocabulary raises an error. Repeated rows get equal results; empty tables give empty tables; a column that is called like the
output is replaced, all others pass through.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
MEMO_WORDS, MEMO_RUNS, MEMO_CHARS, MEMO_PAIRS = 1 << 18, 1 << 19, 64, 1 << 20
PART_ROWS = 64
#: A word with the spaces before it; spaces at the end are one.
WORDS = re.compile(" +[^ ]+| +").findall
#: Runs of Latin letters and of other characters, with the spaces before them.
RUNS = re.compile(f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}]+|{SPACE}+").findall


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """What a model file says: pieces with scores and kinds, and the settings that change results."""

    #: Fixed values of the format: kinds of pieces, and the model type of merges.
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE, MERGES = 1, 2, 3, 4, 5, 6, 2

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normaliser = {}, {}
        for key, value in message:
            if key == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, self.NORMAL))
            elif key == 2:
                trainer = dict(fields(value))
            elif key == 3:
                normaliser = dict(fields(value))
        if trainer.get(3) != self.MERGES or trainer.get(24) or {self.USER, self.UNUSED} & set(self.kinds):
            raise ValueError("the model must be of the merge type, without unused or user-defined pieces or spaces as suffixes")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("the model's normaliser must leave texts as they are")
        self.prefix = bool(normaliser.get(3, 1))
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()


class Tables:
    """What encoding needs: ids and scores of pieces, next shorter tokens, byte ids. Its size is the vocabulary's."""

    def __init__(self, model: Model):
        self.ids = {p: k for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == Model.NORMAL}
        self.scores = {p: model.scores[k] for p, k in self.ids.items()}
        self.bytes = [None] * 256
        for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if kind == Model.BYTE:
                self.bytes[int(p[3:5], 16)] = k
        self.has_bytes = None not in self.bytes
        self.unknown = model.kinds.index(Model.UNKNOWN)
        self.prefix = model.prefix
        self.tokens = [p for p in self.ids if self.merged(p) == [p]]
        known = set(self.tokens)
        self.shorter = {}
        for p in self.tokens:
            if len(p) > 1:
                self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in known), p[0])
        self.made = None
        self.cut_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cut_at_letters = self.cut_at_spaces and all(len(RUNS(p)) == 1 for p in self.ids)

    def merged(self, text: str) -> list[str]:
        """A short text's tokens by merging, step by step."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, place = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, k
            if best is None:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts


    def encoder(self) -> Encoder:
        """The encoder of this process: workers that are used again keep it, with what it remembers, for their next task."""
        self.made = self.made or Encoder(self)
        return self.made


def kept(new: dict, old: dict, most: int, key: str, value: bytes) -> tuple[dict, dict]:
    """The two halves of a memory of `most` entries after a key has been put in."""
    if len(key) < MEMO_CHARS:
        if 2 * len(new) >= most:
            new, old = {}, new
        new[key] = value
    return new, old


class Encoder:
    """Encodes texts by Tables; one for each worker. A token is its number in tables.tokens, or FAR plus the code point of a character
    that no piece has."""

    FAR = 1 << 24

    def __init__(self, tables: Tables):
        self.t = tables
        self.numbers = {p: k for k, p in enumerate(tables.tokens)}
        self.lengths = [len(p) for p in tables.tokens]
        self.ids = [tables.ids[p] for p in tables.tokens]
        self.shorter = [self.number(tables.shorter[p]) if p in tables.shorter else -1 for p in tables.tokens]
        self.find = ahocorasick.Automaton()
        for p, k in self.numbers.items():
            self.find.add_word(p, k)
        if tables.tokens:
            self.find.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.fits: dict[int, int] = {}
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.runs_before: dict[str, bytes] = {}

    def number(self, token: str) -> int:
        """A piece's number, or that of a character without one."""
        found = self.numbers.get(token)
        return self.FAR + ord(token) if found is None else found

    def token(self, number: int) -> str:
        return chr(number - self.FAR) if number >= self.FAR else self.t.tokens[number]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens, joined and merged anew, are these two again."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            one, two = self.token(a), self.token(b)
            found = self.pairs[key] = self.t.merged(one + two) == [one, two]
        return found

    def first_fit(self, before: int, token: int) -> int:
        """The longest of a token and the shorter ones that begin it which is compatible with the token before; -1 if none is."""
        while before >= 0 and not self.compatible(before, token):
            token = self.shorter[token] if token < self.FAR else -1
            if token < 0:
                break
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        return token

    def tokens(self, text: str) -> list[int]:
        """The text's tokens by backtracking."""
        n, far, lengths, shorter, fits = len(text), self.FAR, self.lengths, self.shorter, self.fits
        longest = [-1] * n if n <= MEMO_CHARS else array("i", [-1]) * n
        if self.ids:
            for end, k in self.find.iter(text):  # by end, so the longest of a beginning comes last
                longest[end + 1 - lengths[k]] = k
        failed, any_failed = bytearray((n >> 3) + 1), False
        out: list[int] = []
        at, before, token = 0, -1, longest[0]
        while True:
            if token < 0:
                token = far + ord(text[at])
            key = before << 26 | token
            fit = fits.get(key)
            if fit is None:
                fit = fits[key] = self.first_fit(before, token)
            if fit >= 0:
                end = at + (lengths[fit] if fit < far else 1)
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    out.append(fit)
                    if end == n:
                        return out
                    at, before, token = end, fit, longest[end]
                    continue
                # what fits leads to a place that failed: on with the next shorter one
                if fit < far and shorter[fit] >= 0:
                    token = shorter[fit]
                    continue
            failed[at >> 3] |= 1 << (at & 7)
            any_failed = True
            token = out.pop()
            at -= lengths[token] if token < far else 1
            before = out[-1] if out else -1

    def word(self, text: str) -> bytes:
        """A word's ids as 32-bit integers."""
        tokens = self.tokens(text)
        if max(tokens) < self.FAR:
            return array("i", [self.ids[k] for k in tokens]).tobytes()
        out, lost = array("i"), False
        for k in tokens:
            if k < self.FAR:
                out.append(self.ids[k])
            elif self.t.has_bytes:
                out.extend([self.t.bytes[b] for b in self.token(k).encode("utf-8", "replace")])
            elif not lost:
                out.append(self.t.unknown)
            lost = k >= self.FAR
        return out.tobytes()

    def remembered(self, word: str) -> bytes:
        """The ids of a word after a space, which is not part of `word`. What was asked for since the memory was last half full is kept."""
        found = self.words.get(word)
        if found is None:
            found = self.before.get(word)
            if found is None:
                parts = RUNS(SPACE + word) if self.t.cut_at_letters else ()
                found = b"".join([self.remembered_run(x) for x in parts]) if len(parts) > 1 else self.word(SPACE + word)
            self.words, self.before = kept(self.words, self.before, MEMO_WORDS, word, found)
        return found

    def remembered_run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = self.runs_before.get(run) or self.word(run)
            self.runs, self.runs_before = kept(self.runs, self.runs_before, MEMO_RUNS, run, found)
        return found

    def encode(self, text: str | None) -> bytes:
        """A text's ids as 32-bit integers."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        if not self.t.cut_at_spaces:
            return self.word((SPACE if self.t.prefix else "") + text.replace(" ", SPACE))
        first = b""
        if not self.t.prefix and text[0] != " ":
            head, _, text = text.partition(" ") if " " in text else (text, "", None)
            first = self.word(head)
            if text is None:
                return first
        elif not self.t.prefix:
            text = text[1:]
        # of several spaces in a row the first one is cut off, the others stay with the word
        words = text.split(" ") if "  " not in text and text[:1] != " " else [w[1:].replace(" ", SPACE) for w in WORDS(" " + text)]
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.remembered(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return first + b"".join(found)


class Decoder:
    """Texts of ids."""

    def __init__(self, model: Model):
        self.texts, self.prefix = [], model.prefix
        self.bytes, self.silent, self.led = {}, set(), set()
        for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            self.texts.append("" if kind == Model.CONTROL else model.unknown_text if kind == Model.UNKNOWN else p.replace(SPACE, " "))
            if kind == Model.BYTE:
                self.bytes[k] = int(p[3:5], 16)
                self.texts[k] = chr(self.bytes[k]) if self.bytes[k] < 128 else ""
            elif kind == Model.CONTROL:
                self.silent.add(k)
            elif kind == Model.NORMAL and p[0] == SPACE:
                self.led.add(k)
        #: Bytes below 128 are characters wherever they stand; ids of others make a text be put together one by one.
        self.strings = pa.array(self.texts, pa.string())
        self.apart = np.array([self.bytes.get(k, 0) > 127 for k in range(len(self.texts))], bool)

    def decode(self, ids: list[int | None] | None) -> str:
        """A text by its ids, one by one."""
        parts, run = [], bytearray()
        ids = [i for i in ids or () if i is not None]
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                parts.append(utf8(bytes(run)))
                run.clear()
            parts.append(self.texts[i])
        return self.stripped("".join([*parts, utf8(bytes(run))]), ids)

    def stripped(self, text: str, ids: list[int]) -> str:
        """text without the space that encoding put in front: that of the first piece which shows."""
        return text[1:] if self.prefix and next((i for i in ids if i not in self.silent), -1) in self.led else text

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """The texts of some lists of ids."""
        flat = lists.flatten()
        ids = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.texts)):
            raise ValueError("an id is not in the vocabulary")
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets_of(lists), self.strings.take(pa.array(ids))), "").to_pylist()
        hard = self.apart[ids] | pc.is_null(flat).to_numpy(zero_copy_only=False)
        ends = offsets_of(lists).to_numpy()
        counts = np.concatenate([[0], np.cumsum(hard)])
        slow = counts[ends[1:]] > counts[ends[:-1]]
        out = []
        for k, text in enumerate(joined):
            own = ids[ends[k] : ends[k + 1]]
            out.append(self.decode(lists[k].as_py()) if slow[k] else self.stripped(text, own.tolist() if own.size and int(own[0]) in self.silent else own[:1].tolist()))
        return pa.array(out, pa.string())


def offsets_of(lists: pa.ListArray) -> pa.Array:
    """Where each list begins in the flattened values; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def utf8(data: bytes) -> str:
    """data as UTF-8; each byte that belongs to no character gives U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


def by_parts_of(df: DataFrame, column: str, kind: str, out: str, make) -> DataFrame:
    """df with the column `out`: make() gives, once for each task, the function from some values of `column` to their results."""

    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for values in columns:
            yield pa.concat_arrays([work(values.slice(a, PART_ROWS)) for a in range(0, max(1, len(values)), PART_ROWS)])

    return df.withColumn(out, run(F.col(column)))


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """docs with the column `out`, the ids of text_col by the model at `path` (read on the driver), and, if asked for, with the column `back`, what
    these ids are decoded to, in the same pass over the texts."""
    model = Model(path)
    tables = docs.sparkSession.sparkContext.broadcast((Tables(model), Decoder(model) if back else None))

    def make():
        encoder, decoder = tables.value[0].encoder(), tables.value[1]

        def work(texts: pa.Array) -> pa.Array:
            found = [encoder.encode(t) for t in texts.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
            return ids if decoder is None else pa.StructArray.from_arrays([ids, decoder.decode_all(ids)], names=["ids", "back"])

        return work

    if back is None:
        return by_parts_of(docs, text_col, "array<int>", out, make)
    both = by_parts_of(docs, text_col, "struct<ids:array<int>,back:string>", "__both", make)
    return both.withColumns({out: F.col("__both.ids"), back: F.col("__both.back")}).drop("__both")


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the column `out`, the text of ids_col by the model at `path`."""
    model = docs.sparkSession.sparkContext.broadcast(Decoder(Model(path)))
    return by_parts_of(docs, ids_col, "string", out, lambda: model.value.decode_all)
