"""One query per operator, over whole tables, and their SQL where SQL can say the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import (
    align, archives, decontaminate, divergence, html_extract, jaccard_join, language_id, lm, mixing, quality, quality_model,
    token_files, toxicity,
)
from cohortry.llm.common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    target, raw = quality.bucket_counts(docs, quality.trusted_ids(labels))
    return quality.assess(docs, quality.log_ratios(target, raw))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL["op2_decontamination"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM w, (SELECT DISTINCT n FROM bw))
), h AS (
  SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), p AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p ON p.doc_id IS NOT DISTINCT FROM w.doc_id LEFT JOIN t ON t.doc_id IS NOT DISTINCT FROM w.doc_id
"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


# The taken words are a stretch of the source's shuffled stream, repeated; the targets fill up in order of cap to weight.
SQL["op3_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS fill,
         sum(2.0::DOUBLE * source_size) OVER f AS full_upto, sum(w) OVER () - sum(w) OVER f AS open_after,
         1.5::DOUBLE * sum(source_size) OVER () AS want
  FROM s WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS UNBOUNDED PRECEDING)
), lev AS (
  SELECT max((want - full_before) / open_before) FILTER (WHERE (want - full_before) / open_before < fill) AS level
  FROM (SELECT *, full_upto - 2.0 * source_size AS full_before, open_after + w AS open_before FROM o)
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * level) AS target FROM s, lev
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(
    greatest(0, least(words, a + size) - a) + greatest(0, least(words - source_size, a + size) - a) AS BIGINT) AS taken
FROM p
"""


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


SQL["op4_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = seen
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(seen) FROM reach r WHERE r.doc_id = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = quality_model.estimate(quality_model.pattern_counts(docs))
    return quality_model.classify(docs, *fitted, quality_model.train(docs, *fitted))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"), language_id.accepted().alias("accepted"), "lang_margin")


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = lm.fit(lm.training(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return lm.score(docs, *fitted).withColumn("held_out", id_remainder(F.col("doc_id"), 7) == 2)


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learnable = labels.filter(id_remainder(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(toxicity.labelled(docs, learnable))
    return toxicity.score(docs, model).select(
        "doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 of the 160 digest bits: hexadecimal digits to bits, five bits a letter.
SQL["op11_archives"] = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
         lpad(bin(('0x' || substr(hex, CAST(i AS INT), 1))::INT), 4, '0')), '') AS bits FROM p
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(1, 6), lambda k:
         CASE WHEN substr(bits, CAST(5 * i + k AS INT), 1) = '1' THEN 1 << CAST(5 - k AS INT) ELSE 0 END)) AS INT), 1)), '') AS payload_digest
  FROM b
), m AS (
  SELECT payload_digest, max(page_id) AS head FROM d GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM d JOIN m ON d.payload_digest = m.payload_digest
"""


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


SQL["op12_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS lang_n FROM t GROUP BY lang, term HAVING count(*) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, k.term, k.lang_n, CAST(coalesce(s.n, 0) AS HUGEINT) AS n FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL) s
    ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), p AS (
  SELECT *, 1 + (1000000000 * (n + 5)) // (CAST(sum(n) OVER w AS HUGEINT) + 5 * count(*) OVER w) AS p,
         1 + (1000000000 * (lang_n + 5)) // (CAST(sum(lang_n) OVER w AS HUGEINT) + 5 * count(*) OVER w) AS q
  FROM c WINDOW w AS (PARTITION BY lang, source)
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS sa, b.source AS sb, sum(abs(a.p - b.p)) AS value FROM p a
             JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) x
    ON x.lang = a.lang AND x.sa = a.source AND x.sb = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))
