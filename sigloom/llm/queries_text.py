"""Queries over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .byte_bpe import encode_decode
from .exact_dedup import duplicate_groups
from .jaccard_join import jaccard_classes
from .license_scan import license_blocks
from .line_dedup import ALL, keep_bitmaps, without_lines
from .quality_rules import quality_rules
from .queries import query, table
from .token_counts import sentencepiece_pieces, token_counts

SQL_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


@query("op1_exact_dedup", SQL_DEDUP)
def op1(spark, sf_dir):
    return duplicate_groups(table(spark, sf_dir, "documents"))


SQL_QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         string_split(coalesce(text, ''), chr(10)) AS lines,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (
  SELECT r, i, list_aggregate(words[i:i+7], 'string_agg', ' ') AS win
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM d)),
hits AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM hits, range(0, 8) AS t(k) GROUP BY r),
nl AS (
  SELECT r, source, line, words, whole,
         list_aggregate(words, 'string_agg', ' ') AS norm
  FROM (SELECT r, source, line, whole,
               regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x20\x09-\x0D]+') AS words
        FROM (SELECT r, source, unnest(lines) AS line,
                     md5(translate(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS whole
              FROM d))
  WHERE len(words) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM nl GROUP BY r),
frequent AS (SELECT source, norm FROM nl GROUP BY source, norm HAVING count(DISTINCT whole) > 20),
lost AS (
  SELECT r, sum(len(words)) AS n FROM nl JOIN frequent f ON f.norm = nl.norm AND f.source IS NOT DISTINCT FROM nl.source
  GROUP BY r),
b AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS lost
  FROM d LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r))
SELECT * EXCLUDE (lost), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - lost >= 20 AS kept
FROM b
"""


@query("op6_quality_rules", SQL_QUALITY)
def op6(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    coded = encode_decode(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return coded.select(
        "row.doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_jaccard_join")
def op9(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


@query("op5_license_scan")
def op5(spark, sf_dir):
    return license_blocks(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10(spark, sf_dir):
    pieces = sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(table(spark, sf_dir, "documents"), pieces)


SQL_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, many.key IS NOT NULL AS gone FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op11_line_dedup", SQL_LINES)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = without_lines(docs, keep_bitmaps(docs, min_docs=10, drop=ALL))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
