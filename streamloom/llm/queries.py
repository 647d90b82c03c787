"""The queries of this subpackage, with their production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, jaccard, media, mixing, quality_model, quality_rules, token_counts, toxicity, warc
from .common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_classes(table(spark, sf_dir, "documents"), links=True)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("fail_bits").cast("long").alias("fail_bits"))


def op10_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_html_text": op5_html_text,
    "op6_toxicity": op6_toxicity,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_iso_media": op10_iso_media,
}

_W = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_source_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS reach,
         1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER p, 0) AS capped, weights - coalesce(sum(weight) OVER p, 0) AS free
  FROM c WINDOW p AS (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((budget - capped) / free, reach) AS level FROM o WHERE (budget - capped) / free <= reach),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM c, l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken
FROM q""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS w, string_split(t, chr(10)) AS ls FROM d),
b AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(t) - len(replace(t, '!', '')) AS BIGINT) AS n_shouts,
         list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln, w
  FROM a),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
p AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, i + k AS j FROM r, (VALUES (0), (1), (2)) AS v(k)) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(len(ln) AS BIGINT) AS n_lines,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_shouts
  FROM b LEFT JOIN p ON b.doc_id = p.doc_id),
f AS (
  SELECT *, CAST({' + '.join(f'CASE WHEN {cond} THEN {1 << i} ELSE 0 END' for i, (_, cond) in enumerate(quality_rules.RULES))} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {quality_rules.mask(quality_rules.BASE)}) <> 0 AS base_failed,
       (fail_bits & {quality_rules.mask(quality_rules.POLICIES[quality_rules.CURRENT])}) = 0 AS kept, fail_bits
FROM f""",
}
