"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator and stage."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import audio, decontaminate, html_extract, langid, mixing, pii, quality, simhash, suffix_dedup, toxicity

LONG = "the quick brown fox and the lazy dog are in it for all of that " * 800
TEXTS = [None, "", " \t\n", "a", "hello world of the words", LONG, "hello world of the words", "%%% !!! ...", "née à l'été 1999", "😀 😀", "\x00\x01", "mail me@example.org or +1 (555) 010-9999 now"]
CLASH = "score double, size long, source_size long, target double, copies long, spans string, fingerprint string, component_id long, n_words long, n_hit long, items string, hits string, contaminated boolean, language string, media string, audio string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, quality_score double, toxicity double"
NAMES = [c.split()[0] for c in CLASH.split(", ")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 2}", None) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s0", 3), (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    out = docs
    for part in CLASH.split(", "):
        name, kind = part.split()
        out = out.withColumn(name, F.lit(None).cast(kind))
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)] + [(1, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Hello, WORLD of"), (2, None), (3, ""), (4, " ".join(LONG.split()[:20])), (5, "hello world of")], "item_id long, text string")


def operators(bench, labels):
    def scored(module, out):
        if module is quality:
            return lambda d: quality.score(d, (v := quality.word_vectors(d)), quality.fit(d, labels, v, per_label=50), out=out)
        return lambda d: toxicity.score(d, toxicity.fit(d, labels, per_label=50), out=out)

    return {
        "op2": lambda d: decontaminate.find(d, bench), "op3": scored(quality, "quality_score"), "op4": lambda d: audio.features(audio.store(d)), "op5": simhash.classes, "op6": lambda d: langid.predict(d, langid.fit(d)),
        "op7": mixing.mix, "op8": suffix_dedup.dedup, "op9": pii.detect, "op9 sanitise": pii.sanitise, "op10": scored(toxicity, "toxicity"), "op2 spans": lambda d: decontaminate.remove(d, bench, mode="spans"),
        "op5 keep": simhash.keep_one, "op7 emit": mixing.emit, "op8 remove": suffix_dedup.remove, "op2 remove": lambda d: decontaminate.remove(d, bench),
    }


ALL = ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op9 sanitise", "op10", "op2 spans", "op5 keep", "op7 emit", "op8 remove", "op2 remove"]
FEWER = {"op5 keep", "op7 emit", "op2 remove"}


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_and_clashing_columns(docs, clashing, bench, labels, name):
    f = operators(bench, labels)[name]
    got, plain = f(clashing), f(docs)
    assert len(set(got.columns)) == len(got.columns)
    assert {c for c in docs.columns if c != "text" or c in plain.columns} <= set(got.columns)
    a, b = got.select(*sorted(set(plain.columns) & set(got.columns))).toPandas(), plain.toPandas()
    assert len(a) == len(b)
    if name not in FEWER:
        assert len(b) == len(TEXTS) + 2


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, bench, labels, name):
    assert operators(bench, labels)[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_side_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated or r.n_hit for r in decontaminate.find(docs, empty).collect())
    assert {r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    vectors = quality.word_vectors(docs)
    assert {r.quality_score for r in quality.score(docs, vectors, quality.fit(docs, none, vectors)).collect()} == {0.5}
    assert {r.language["lang_pred"] for r in langid.predict(docs, langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_op1(spark):
    pages = [None, "", "<p>", "<<<", "plain words", "<article><p>One<br>two</p><p>&amp;lt;</p></article>", "<nav>menu</nav>", "<p class='x" + "y" * 100_000, "<article><h1>T</h1><aside>no</aside><p>yes <a href='/'>link</a> it is</p><section class='comments'><p>me too</p></section></article>"]
    frame = spark.createDataFrame([(k, None, p, "old") for k, p in enumerate(pages)] + [(0, None, None, "old")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(frame).collect()}
    assert got[0] == ("", 0) and got[1] == ("", 0) and got[5] == ("One two &lt;", 12) and got[6] == ("", 0) and got[8][0] == "T yes link it is"
    assert html_extract.extract(frame.limit(0)).count() == 0 and html_extract.extract(frame).count() == len(pages) + 1


def test_op1_rules():
    long = "This is the text of a long story that goes on and on for the sake of the test in it."
    page = f"<body><div class='menu'><a href='/'>Home</a></div><p><a href='/'>{long}</a></p><p>{long}</p><p>Short.</p><div id='cookie-notice'>{long}</div><form>{long}</form><footer>{long}</footer></body>"
    assert html_extract.main_text(page) == f"{long} Short."
    assert html_extract.main_text(f"<script>var t = '<p>{long}</p>'</script><style>p{{}}</style><!-- <p>{long}</p> --><p>{long}") == long
    assert html_extract.main_text(f"<main><header><h1>Kept</h1></header><p>{long}</p><ul class='related'><li>{long}</li></ul></main><p>{long}</p>") == f"Kept {long}"


def test_op2_short_items_and_copies(docs, bench):
    got = {(r.doc_id, r.text): r for r in decontaminate.find(docs, bench).collect()}
    hello = got[4, TEXTS[4]]
    assert (hello.n_words, hello.n_hit, list(hello["items"]), list(hello.hits), hello.contaminated) == (5, 3, [1, 5], [0, 1, 2], True)
    assert list(got[5, LONG]["items"]) == [4] and got[5, LONG].n_hit == got[5, LONG].n_words
    assert (got[0, None].n_words, got[0, None].contaminated) == (0, False)
    assert decontaminate.find(docs, bench).where("doc_id = 4").count() == 2
    same = decontaminate.find(docs, bench, broadcast_bytes=0).select("doc_id", "n_hit", "n_words")
    assert sorted(map(tuple, same.na.fill(-1).collect())) == sorted((r.doc_id if r.doc_id is not None else -1, r.n_hit, r.n_words) for r in decontaminate.find(docs, bench).collect())
    kept = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, mode="spans").collect()}
    assert kept[4] == " the words" and kept[0] is None


def test_op3_and_op10_learn(spark):
    rng = np.random.default_rng(0)
    words = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(600):
        own = list(rng.choice(words, 40))
        bad = k % 3 == 0
        if bad:
            own[int(rng.integers(40))] = "vile" + "abcdefgh"[k % 8]
        rows.append((k, " ".join(own) if k % 2 else " ".join(f"{w}!!" for w in own), int(bad), int(k % 2)))
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, b) for k, _, b, q in rows], "doc_id long, quality int, toxic int")
    vectors = quality.word_vectors(docs)
    good = quality.score(docs, vectors, quality.fit(docs, labels, vectors), out="s").join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).toPandas()
    assert ((good["s"] >= 0.5) == (good["quality"] == 1)).mean() > 0.95
    bad = toxicity.score(docs, toxicity.fit(docs, labels), out="s").join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    assert ((bad["s"] >= 0.5) == (bad["toxic"] == 1)).mean() > 0.9


def test_op4_round_trip(docs):
    rows = audio.features(audio.store(docs)).collect()
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert audio.from_wav(bytes(r.media["data"])) == payload and r.media["n_bytes"] == len(raw)
        assert r.audio["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r.audio["media_sha256"] == hashlib.sha256(bytes(r.media["data"])).hexdigest()
        table = pa.ipc.open_stream(bytes(r.audio["tensors"])).read_all()
        assert table["log_mel"].type.shape == [audio.FRAMES, audio.MELS] and table.num_rows >= 1
        assert all(a <= b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))
    same = [r.audio["summary"] for r in rows if r.text == TEXTS[4]]
    assert len(set(same)) == 1 and len(same) == 3
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFF" + bytes(60))


def test_op4_tone():
    t = np.arange(16000) / 16000
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t) * (t > 0.5)).astype(np.uint8)
    mel = audio.log_mel(tone)
    loud = mel[len(mel) * 3 // 4]
    top = 16000 * audio.UP / audio.DOWN / 2
    at = 2595 * np.log10(1 + 1000 / 700) / (2595 * np.log10(1 + top / 700)) * (audio.MELS + 1) - 1
    assert abs(loud.argmax() - at) <= 1
    (a, b), *rest = audio.segments(mel.mean(1))
    assert not rest and abs(a / len(mel) - 0.5) < 0.05 and b >= len(mel) - 2


def test_op6(docs, spark):
    train = spark.createDataFrame([(k, "the cat and the dog are in the house of it", "en", None, 1) for k in range(20)] + [(k, "der hund und die katze sind in dem haus", "de", None, 1) for k in range(20, 40)], SCHEMA)
    profiles = langid.fit(train)
    got = {r.text: r.language for r in langid.predict(docs, profiles).collect()}
    assert {got[t]["lang_pred"] for t in (None, "", " \t\n", "%%% !!! ...", "😀 😀")} == {"und"} and got[LONG]["lang_pred"] == "en"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    foreign = langid.predict(spark.createDataFrame([("日本語",)], "text string"), profiles).first().language
    assert foreign["lang_pred"] in ("de", "en")


def test_op7_targets_and_bounds(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 17)), None if k % 10 == 0 else "hot" if k % 3 else f"s{k % 4}") for k in range(3000)] + [(5, "a b", "one"), (5, "a b", "one"), (7, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).toPandas()
    assert ((out["copies"] >= 0) & (out["copies"] <= 2)).all()
    for _, g in out.groupby(out["source"].fillna("~")):
        taken, target = (g["copies"] * g["size"]).sum(), g["target"].iloc[0]
        assert abs(taken - target) <= 2 * g["size"].max() + 1e-9
        assert target <= 2 * g["source_size"].iloc[0]
    total = out.drop_duplicates("source")["target"].sum()
    assert total == pytest.approx(1.5 * out["size"].sum())
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(map(tuple, out[["doc_id", "size", "copies"]].values.tolist())) == sorted(map(tuple, again[["doc_id", "size", "copies"]].values.tolist()))
    assert mixing.emit(docs).count() == out["copies"].sum()


def terms_in(row):
    return {row.text[s["start"] : s["end"]] for s in row.spans if s["kind"] == "term"}


@pytest.fixture(scope="module")
def planted(spark):
    """`zorbax` and `quilp` stand by one address each, one of them in a single text; all other words are frequent."""
    filler = ["words of the text that stand here for all", "other words of the text stand here", "nothing of the words in the text here", "all that stand here for other text", "in the text for all"]
    rare = ["call zorbax here at boss@corp.example for the text", "all zorbax words of the text boss@corp.example", "quilp stand here +1 (555) 010-9999 for all"]
    return spark.createDataFrame(list(enumerate([*rare, *[f"{x} {y}" for x in filler for y in filler], "zorbax of the text", None, ""])), "doc_id long, text string")


def test_op7_targets_of_many_sources(spark):
    """Against a plain filling up of levels; sums over parts equal those over all."""
    rng = np.random.default_rng(7)
    sizes = {f"host{k:05d}": int(n) for k, n in enumerate(rng.integers(0, 1000, 3000) ** 2)} | {None: 5000}
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * rest / total > 2 * sizes[s] + 1e-6}
        if not above:
            break
        for s in above:
            want[s] = 2.0 * sizes[s]
            rest -= want[s]
        free -= above
    want |= {s: weight[s] * rest / total for s in free}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(9)).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


@pytest.mark.parametrize("unit", [10**6, 2**29, 2**31, 10**12])
def test_op7_targets_of_large_sources(spark, unit):
    """Sums below and above 2 ** 31 whose multiples are beyond it."""
    sizes = [("a", unit + 1), ("b", 9 * unit), ("c", 9 * unit)]  # a stops at its limit, so b and c (1 and 2) share the rest
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    rest = 3 * sum(n for _, n in sizes) / 2 - 2 * (unit + 1)
    assert got == {"a": 2.0 * (unit + 1), "b": pytest.approx(rest / 3), "c": pytest.approx(2 * rest / 3)}


def test_op9_terms(planted):
    out = {r.doc_id: r for r in pii.detect(planted).collect()}
    assert {r.term for r in pii.disclosing(planted).collect()} == {"zorbax", "quilp", "call"}
    assert terms_in(out[0]) == {"call", "zorbax"} and terms_in(out[1]) == {"zorbax"} and terms_in(out[2]) == {"quilp"} and terms_in(out[28]) == {"zorbax"}
    assert not any(terms_in(out[k]) for k in range(3, 28)) and out[29].spans == [] == out[30].spans
    by_join = {r.doc_id: r.spans for r in pii.detect(planted, broadcast_bytes=0).collect()}
    assert {k: [tuple(s) for s in v] for k, v in by_join.items()} == {k: [tuple(s) for s in r.spans] for k, r in out.items()}
    clean = {r.doc_id: r.text for r in pii.sanitise(planted).collect()}
    assert clean[0] == "[WORD] [WORD] here at [EMAIL] for the text" and clean[3] == out[3].text and clean[29] is None
    assert {r.term for r in pii.disclosing(planted, left_bits=0.9).collect()} == set()


@pytest.mark.parametrize("broadcast_bytes", [0, pii.BROADCAST_BYTES])
def test_sanitise_replaces_in_the_kernel_that_finds(planted, broadcast_bytes):
    """Texts pass Python once: two kernels in one task hold two Python workers for each core. The texts are those the spans give."""

    def by_spans(text, spans):
        parts, at = [], 0
        for s in spans or []:
            if s.start >= at:
                general = "" if s.bits is not None and s.bits <= pii.REMOVE_BITS else "[NAME]" if text[s.start].isupper() else "[WORD]"
                parts += [text[at : s.start], general if s.kind == pii.TERM else f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        return text if text is None else "".join(parts) + text[at:]

    clean = pii.sanitise(planted, broadcast_bytes=broadcast_bytes)
    plan = clean._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == (1 if broadcast_bytes else 2)  # the second finds the words of each text, in a branch of its own
    want = {r.doc_id: by_spans(r.text, r.spans) for r in pii.detect(planted).collect()}
    assert {r.doc_id: r.text for r in clean.collect()} == want


@pytest.mark.parametrize("broadcast_copies", [0, pii.BROADCAST_COPIES])
def test_op9_copies_count_once(spark, planted, broadcast_copies):
    """Any number of copies of any text changes nothing."""
    copies = planted.withColumn("n", F.expr("array_repeat(1, int(1 + doc_id * 7 % 11 + if(doc_id = 28, 90, 0)))")).select("doc_id", "text", F.explode("n")).drop("col")
    found = lambda d: {(r.term, r.bits) for r in pii.disclosing(d, broadcast_copies=broadcast_copies).collect()}
    assert found(copies.repartition(5)) == found(planted) != set()


def test_op9_neighbours_are_words_of_any_length():
    long = "Margaret " + "x" * 300 + " " + "y" * 200 + " bob@ex.com " + "z" * 400 + " tail 10.0.0.1"
    found = pii.nearby(long, pii.base_spans(long))
    assert {t for e, t in found if e == "email:bob@ex.com"} == {"margaret", "x" * 300, "y" * 200, "z" * 400, "tail"}
    text = " ".join(f"{chr(97 + k) * 4}" for k in range(12)) + " a@b.c " + " ".join(f"{chr(97 + k) * 5}" for k in range(12))
    assert {t for _, t in pii.nearby(text, pii.base_spans(text))} == {chr(97 + k) * 4 for k in range(12 - pii.NEAR, 12)} | {chr(97 + k) * 5 for k in range(pii.NEAR)}


def test_op9_entity_of_most_texts_discloses_nothing(spark):
    rows = [f"word{chr(97 + k)} all@corp.example" for k in range(20)]
    assert pii.disclosing(spark.createDataFrame([(t,) for t in rows], "text string")).count() == 0


def test_op5_keeps_one_row_of_each_class(spark):
    """Repeated rows, two texts under one id, ids of other classes' heads and classes of null ids."""
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(30)) for w in ("red", "green", "blue", "grey"))
    rows = [(1, one, "a"), (1, one, "a"), (1, one, "b"), (2, one, "a"), (2, two, "a"), (2, two, "a"), (1, two, "a"), (None, two, "a"), (None, three, "a"), (None, three, "a"), (None, three, None), (None, four, "a"), (None, four, "a"), (5, None, None), (5, "", None), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = sorted((r.text or "", r.doc_id or 0) for r in simhash.keep_one(docs).collect())
    assert got == sorted([(one, 1), (two, 1), (three, 0), (four, 0), ("", 5)])
    again = simhash.keep_one(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, simhash.keep_one(docs).collect()))
    single = docs.where("doc_id = 2").distinct()
    assert simhash.keep_one(single).count() == 2


def test_stages(spark, tmp_path):
    rows = [(k, t, "en", None if k % 3 == 0 else f"s{k % 2}", 1) for k, t in enumerate(TEXTS)] + [(20 + k, f"this is the text of document number {k} and it has a number of words {k * 7919} in it", "en", "s1", 70) for k in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "hello world of the words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(docs) - ids(corpus_pipeline.language(spark, docs, str(tmp_path))) == {0, 1, 2, 7, 9, 10}
    assert ids(docs) - ids(corpus_pipeline.near_dedup(spark, docs, str(tmp_path))) >= {1, 2, 6}
    assert ids(docs) - ids(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == {4, 6}
    assert "[EMAIL]" in {r.doc_id: r.text for r in corpus_pipeline.private(spark, docs, str(tmp_path)).collect()}[11]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 4 not in ids(out) and out.columns == list(corpus_pipeline.COLUMNS)


def test_series_of_nothing():
    assert pd.Series(quality.Network().scores(np.zeros((0, 2)))).empty
