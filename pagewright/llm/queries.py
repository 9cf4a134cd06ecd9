"""The corpus operators applied to the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import audio, collocations, decontaminate, fill_middle, html_extract, langid, mixing, pii, quality, sentencepiece_bpe, simhash, suffix_dedup, toxicity
from pagewright.llm.common import remainder, spread, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    found = found.withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    vectors = quality.word_vectors(docs)
    network = quality.fit(docs, table(spark, sf_dir, "labels"), vectors)
    return _decided(quality.score(docs, vectors, network, out="score"), 3, 1)


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = audio.store(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    found = audio.features(stored.select("doc_id", "media"))
    return found.select(
        "doc_id", F.col("media.n_bytes").alias("n_bytes"), F.col("audio.payload_bytes").alias("payload_bytes"), F.col("audio.payload_sha256").alias("payload_sha256"),
        F.col("audio.tail_crc32").alias("tail_crc32"), F.octet_length("media.data").cast("long").alias("media_bytes"), F.col("audio.media_sha256").alias("media_sha256"), F.col("audio.summary").alias("feature"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", 5) == 0
    profiles = langid.fit(docs.where(~held))
    found = langid.predict(spread(docs.select("doc_id", "text")), profiles)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the words are counted here, so that the texts need not travel along
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("n")), text_col=None, size_col="n")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.withColumn("removed", F.col("n_removed") > 0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"] != pii.TERM)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _decided(toxicity.score(docs, network, out="score"), 5, 0)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return fill_middle.restore(cut).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_bpe.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), path, back="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(spread(table(spark, sf_dir, "documents").select("lang", "text")))


def _decided(scored: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_decontamination, op3_quality, op4_audio, op5_simhash, op6_language, op7_mixing, op8_suffix_dedup, op9_pii, op10_toxicity, op11_fill_in_middle, op12_sentencepiece, op13_collocations)
}

#: op2: windows of both sides by list slices, joined on their text.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)
), h AS (
  SELECT dw.doc_id, dw.s, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM h) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

#: op7: the same targets, ranks and integer crossings by windows over whole sources.
OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('{mixing.SEED}:' || CAST(doc_id AS VARCHAR)) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM d GROUP BY source
), r AS (
  SELECT *, coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS everything
  FROM s WINDOW w AS (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST)
), f AS (
  SELECT *, (3 * everything - 4 * below) * weight <= 4 * source_size * rest AS free FROM r
), l AS (
  SELECT min({{'r': source_size / CAST(weight AS DOUBLE), 'below': below, 'rest': rest}}) AS first FROM f WHERE free
), t AS (
  SELECT source, source_size, CASE WHEN free THEN weight * (3 * everything - 4 * l.first.below) / (2.0::DOUBLE * l.first.rest) ELSE 2.0::DOUBLE * source_size END AS target FROM f, l
), k AS (
  SELECT d.doc_id, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.key, d.doc_id) AS k,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate * k + {mixing.offset(mixing.SEED)!r}::DOUBLE) - floor(rate * (k - 1) + {mixing.offset(mixing.SEED)!r}::DOUBLE)) AS BIGINT) AS taken FROM k
"""

#: op11: lines by splitting at line feeds instead of by a pattern; restored_sha256 is that of the text itself.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS p, sha256('7:' || CAST(doc_id AS VARCHAR)) AS hex FROM documents
), l AS (
  SELECT *, CAST(len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS BIGINT) AS n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR strpos(text, '<P>') + strpos(text, '<S>') + strpos(text, '<M>') > 0 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l
), e AS (
  SELECT *, CASE WHEN a = 0 THEN 0 ELSE length(array_to_string(p[1:a], '-')) + CASE WHEN a < len(p) THEN 1 ELSE 0 END END AS i,
    CASE WHEN b = 0 THEN 0 ELSE length(array_to_string(p[1:b], '-')) + CASE WHEN b < len(p) THEN 1 ELSE 0 END END AS j FROM c
), x AS (
  SELECT *, substr(text, 1, i) AS pre, substr(text, i + 1, j - i) AS mid, substr(text, j + 1) AS suf FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(i AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(j - i AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM x
"""

#: op13: phrases by list slices of each piece's words, counted as they stand.
OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), s AS (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS k(size) WHERE len(w) >= size
), c AS (
  SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE size = 1 GROUP BY lang
), x AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS v FROM c WHERE size > 1 AND f >= 30
), cuts AS (
  SELECT x.*, unnest(range(1, size)) AS k FROM x
), scored AS (
  SELECT cuts.*, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts JOIN c l ON l.lang = cuts.lang AND l.phrase = array_to_string(v[1:k], ' ') JOIN c r ON r.lang = cuts.lang AND r.phrase = array_to_string(v[k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, a, array_to_string(v[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT x.*, unnest(range(2, size)) AS k FROM x))
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM inner_phrases GROUP BY ALL
), left_over AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase WHERE longer.a IS NULL OR 100 * CAST(longer.a AS HUGEINT) < 80 * CAST(best.a AS HUGEINT)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op13_collocations": OP13_SQL, "op11_fill_in_middle": OP11_SQL, "op2_decontamination": OP2_SQL, "op7_mixing": OP7_SQL}
