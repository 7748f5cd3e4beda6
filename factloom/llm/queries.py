"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .mixing import BLOCK, mix_report
from .mpeg_audio import audio_columns
from .near_dedup import near_duplicates
from .packing import pack
from .pii import find_pii
from .quality_classifier import quality_classifier
from .quality_rules import MAX_REPEAT_PERCENT, MEASURES, MIN_DOCS, MIN_WORDS, SPREADS, TOLERANCE, quality_rules
from .repeats import repeats_report
from .token_files import token_report
from .warc import archive_report

TOKENIZER_DIR = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio_columns(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"), width=2)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_50k.json") -> DataFrame:
    return pack(spark, read(spark, sf_dir, "documents"), tokenizer)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark, read(spark, sf_dir, "documents"), BLOCK)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark, read(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = f"{TOKENIZER_DIR}/word_bpe_49k.json") -> DataFrame:
    return token_report(spark, read(spark, sf_dir, "documents"), tokenizer)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_report(spark, read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(spark, read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_quality_classifier, op3_mpeg_audio, op4_minhash_near_dedup, op5_best_fit_packing,
        op6_source_mixing, op7_pii, op8_token_files, op9_warc, op10_suffix_dedup,
    )
}


def _quality_rules_sql() -> str:
    measures = ", ".join(f"CASE WHEN {den} > 0 THEN {factor} * {num} // {den} ELSE 0 END AS {m}" for m, (num, den, factor, _) in MEASURES.items())
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v, {how[3]} AS share FROM measured" for m, how in MEASURES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
t AS (SELECT r, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
per AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, sum(length(regexp_replace(word, '[^#*$%&|<>]', '', 'g'))) AS n_symbols,
  sum(length(regexp_replace(word, '[^A-Z]', '', 'g'))) AS n_caps, sum(length(regexp_replace(word, '[^!]', '', 'g'))) AS n_bangs FROM w GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counts AS (SELECT d.r, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_symbols, 0)::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_caps, 0)::BIGINT AS n_caps, coalesce(n_bangs, 0)::BIGINT AS n_bangs
  FROM d LEFT JOIN per USING (r) LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
measured AS (SELECT *, {measures} FROM counts),
long AS ({each}),
bucketed AS (SELECT *, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)::INTEGER) END AS b FROM long),
sketch AS (
  SELECT 'own' AS level, lang, source, measure, share, b, count(*) AS n FROM bucketed GROUP BY lang, source, measure, share, b
  UNION ALL SELECT 'language', lang, NULL, measure, share, b, count(*) FROM bucketed GROUP BY lang, measure, share, b
  UNION ALL SELECT 'all', NULL, NULL, measure, share, b, count(*) FROM bucketed GROUP BY measure, share, b),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS cum, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM sketch),
q AS (SELECT level, lang, source, measure, share, total, min(CASE WHEN cum * 2 >= total THEN b END) AS b50, min(CASE WHEN cum * 4 >= total * 3 THEN b END) AS b75,
  min(CASE WHEN cum * 100 >= total * 99 THEN b END) AS b99 FROM cum GROUP BY level, lang, source, measure, share, total),
top AS (SELECT *, CASE WHEN b50 < 64 THEN b50 ELSE (((b50 - 32) % 32 + 33) << ((b50 - 32) // 32)::INTEGER) - 1 END AS q50,
  CASE WHEN b75 < 64 THEN b75 ELSE (((b75 - 32) % 32 + 33) << ((b75 - 32) // 32)::INTEGER) - 1 END AS q75,
  CASE WHEN b99 < 64 THEN b99 ELSE (((b99 - 32) % 32 + 33) << ((b99 - 32) // 32)::INTEGER) - 1 END AS q99 FROM q),
fences AS (SELECT *, q75 + {SPREADS} * (q75 - q50) AS spread, share * q99 // 100 AS low FROM top),
chosen AS (
  SELECT o.lang, o.source, o.measure, {TOLERANCE} + greatest(CASE WHEN o.total >= {MIN_DOCS} THEN o.spread WHEN l.total >= {MIN_DOCS} THEN l.spread ELSE a.spread END,
    CASE WHEN l.total >= {MIN_DOCS} THEN l.low ELSE a.low END) AS fence
  FROM fences o JOIN fences l ON o.level = 'own' AND l.level = 'language' AND o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure
  JOIN fences a ON a.level = 'all' AND a.measure = o.measure),
ok AS (SELECT m.r, bool_and(CASE f.measure {" ".join(f"WHEN '{m}' THEN m.{m} <= f.fence" for m in MEASURES)} END) AS within
  FROM measured m JOIN chosen f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source GROUP BY m.r),
base AS (SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, within AND NOT base_failed AS kept FROM base JOIN ok USING (r)
"""


NEAR_DUPLICATES_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM w WHERE len(ws) > 1
  UNION SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least_ AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least_ LEFT JOIN n USING (doc_id)
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_ FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_ THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_ THEN first_ END AS refers_to FROM f
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": _quality_rules_sql(),
    "op4_minhash_near_dedup": NEAR_DUPLICATES_SQL,
    "op9_warc": WARC_SQL,
}
