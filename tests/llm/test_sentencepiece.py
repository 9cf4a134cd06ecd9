"""Encoding and decoding against the library, and against plain merging for models of other kinds."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import queries
from pagewright.llm import sentencepiece_bpe as sp

public_tokenizers = pytest.importorskip("public_tokenizers")
library = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "abcdehinorst THE'.,\n\t▁<0xA>/\\s-=*äéßñ中文語한😀\x00​\U0010ffff²\r"


@pytest.fixture(scope="module")
def model():
    return sp.Model(PATH)


@pytest.fixture(scope="module")
def encoder(model):
    return sp.Tables(model).encoder()


@pytest.fixture(scope="module")
def theirs():
    return library.SentencePieceProcessor(model_file=PATH)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def test_model_file_is_read_as_the_library_reads_it(model, theirs):
    assert len(model.pieces) == theirs.vocab_size()
    for k in range(0, len(model.pieces), 7):
        assert model.pieces[k] == theirs.id_to_piece(k) and abs(model.scores[k] - theirs.get_score(k)) < 1e-6


@settings(max_examples=600, deadline=None, suppress_health_check=[])
@given(text=st.text(ALPHABET, max_size=80))
def test_equals_the_library(encoder, model, theirs, text):
    found = ids(encoder, text)
    assert found == theirs.encode(text)
    assert sp.Decoder(model).decode(found) == theirs.decode(found)


def test_long_texts_without_spaces(encoder, theirs):
    r = random.Random(3)
    for text in ("a" * 50_000, "ab" * 20_000, " " * 9999, "\n" * 9999, "".join(r.choices("abcdefghij0123456789+/", k=60_000)), "中" * 5000, "tthhee" * 9000):
        assert ids(encoder, text) == theirs.encode(text)


def test_any_ids_are_decoded(model, theirs):
    r, decoder = random.Random(5), sp.Decoder(model)
    lists = [[r.randrange(300) if r.random() < 0.5 else r.randrange(32000) for _ in range(r.randint(0, 9))] for _ in range(3000)]
    assert decoder.decode_all(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [theirs.decode(x) for x in lists] == [decoder.decode(x) for x in lists]
    odd = pa.array([None, [], [13, None, 6312], [1, 2], None], pa.list_(pa.int32()))
    assert decoder.decode_all(odd).to_pylist() == ["", "", "\n" + theirs.id_to_piece(6312).replace("▁", " "), "", ""]
    for bad in ([-1], [32000]):
        with pytest.raises(ValueError):
            decoder.decode_all(pa.array([bad], pa.list_(pa.int32())))


class Small:
    """A model of random pieces: some don't merge to themselves, some hold spaces inside, scores tie, there are no byte pieces."""

    def __init__(self, seed, prefix):
        r = random.Random(seed)
        letters = "ab▁é"
        made = {"a", "b", "▁"} | {"".join(r.choices(letters, k=r.randint(2, 5))) for _ in range(25)}
        self.pieces = ["<unk>", *sorted(made)]
        self.scores = [0.0] + [float(-r.randint(0, 12)) for _ in made]
        self.kinds = [sp.Model.UNKNOWN] + [sp.Model.NORMAL] * len(made)
        self.prefix, self.unknown_text = prefix, "?"


@pytest.mark.parametrize("seed", range(30))
def test_random_models_by_plain_merging(seed):
    tables = sp.Tables(Small(seed, seed % 2 == 0))
    encoder, r = tables.encoder(), random.Random(seed)
    for _ in range(300):
        text = "".join(r.choices("ab éx", k=r.randint(0, 14)))
        want = tables.merged(("▁" if tables.prefix and text else "") + text.replace(" ", "▁"))
        plain = [tables.ids.get(t, tables.unknown) for t in want]
        plain = [t for k, t in enumerate(plain) if t != tables.unknown or not k or plain[k - 1] != tables.unknown]
        assert ids(encoder, text) == plain, text


def test_memory_of_words_is_bounded(model, monkeypatch):
    monkeypatch.setattr(sp, "MEMO_WORDS", 20)
    monkeypatch.setattr(sp, "MEMO_RUNS", 20)
    monkeypatch.setattr(sp, "MEMO_PAIRS", 20)
    encoder, fresh = sp.Tables(model).encoder(), sp.Tables(model).encoder()
    texts = [" ".join(f"w{k * j}x" for j in range(9)) for k in range(60)]
    assert [encoder.encode(t) for t in texts + texts] == [fresh.encode(t) for t in texts + texts]
    assert len(encoder.words) + len(encoder.before) <= 21 and len(encoder.runs) + len(encoder.runs_before) <= 21 and len(encoder.pairs) <= 21 and len(encoder.fits) <= 21


def test_other_models_are_refused(tmp_path, model):
    data = open(PATH, "rb").read()
    # the trainer's field 3 says which type a model has
    at = data.index(bytes([3 << 3, sp.Model.MERGES]), data.index(b"shuffled.txt"))
    (tmp_path / "other.model").write_bytes(data[: at + 1] + b"\1" + data[at + 2 :])
    with pytest.raises(ValueError):
        sp.Model(str(tmp_path / "other.model"))


def test_odd_rows_empty_tables_and_clashing_columns(spark, theirs):
    texts = [None, "", " ", "  two  spaces  ", "hello world", "hello world", "\x00", "née 😀 中文", "word " * 30_000]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)] + [(None, "x", None)], "doc_id long, text string, ids string").withColumn("decoded", F.lit(1))
    got = sp.decode(sp.encode(docs, PATH), PATH)
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "text"] and got.count() == len(texts) + 1
    for r in got.collect():
        assert r["ids"] == theirs.encode(r.text or "") and r.decoded == (r.text or "")
    assert sp.decode(sp.encode(docs.limit(0), PATH), PATH).count() == 0
    both = sp.encode(docs, PATH, back="decoded")
    assert sorted(both.columns) == sorted(got.columns) and both.exceptAll(got.select(*both.columns)).count() == 0 and sp.encode(docs.limit(0), PATH, back="decoded").count() == 0


def test_query_by_the_library(spark, theirs):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the given tables")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_sentencepiece(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        found = theirs.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(found).encode()).hexdigest()
