"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import functions as F

from .chat_format import masked_text, parse_turns, prefix_targets
from .mixing import poisson_mix
from .queries import query, table
from .shared import stored

SQL_MIX = r"""
WITH d AS (SELECT *, coalesce(cast(doc_id AS VARCHAR), 'null') AS i FROM documents),
sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS chars FROM d GROUP BY source),
rates AS (
  SELECT source, sqrt(chars) / sum(sqrt(chars)) OVER () * sum(chars) OVER () / chars AS rate FROM sizes WHERE chars > 0),
steps AS (
  SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM rates, range(0, 150) AS t(k)),
draws AS (
  SELECT d.*, (('0x' || substr(md5('17|' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS draw FROM d),
counts AS (
  SELECT i, doc_id, text, lang, d.source, n_chars, count(*) AS n
  FROM draws d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.p < d.draw GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, c.copy_no::BIGINT AS copy_no, md5('17|' || i || '|' || c.copy_no) AS shuffle_key
FROM counts, unnest(range(1, n + 1)) AS c(copy_no)
"""


@query("op8_poisson_mix", SQL_MIX)
def op8(spark, sf_dir):
    mixed = poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.*", F.col("copy_no").cast("bigint").alias("copy_no"), "shuffle_key")


SQL_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS last,
    sum(14 + length(role) + length(text) + length(regexp_replace(role, '[^\\<#:]', '', 'g'))
        + length(regexp_replace(text, '[^\\<#]', '', 'g'))) OVER w AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) FILTER (role = 'assistant' OR i = last))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""


@query("op7_prefix_targets", SQL_CHAT)
def op7(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    probes = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    examples = stored(prefix_targets(turns.unionByName(probes)))
    per_talk = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.sort_array(
            F.collect_list(F.when(F.col("trained"), F.struct("n_turns", masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text"))))
        ).alias("replies"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    lines = F.transform(parse_turns(F.col("whole")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("replies", lambda r: r["text"]), "")
    return per_talk.select("conv_id", lines.alias("lines"), loss.alias("loss"), "formatted_chars").select(
        "conv_id",
        F.size("lines").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
