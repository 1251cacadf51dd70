"""Queries over ``pages``."""

from __future__ import annotations

from .queries import query, table
from .url_filter import judge_urls
from .warc import archive_and_index

SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest,
             max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM s
"""


@query("op2_warc", SQL_WARC)
def op2(spark, sf_dir):
    index = archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("op3_url_filter")
def op3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, table(spark, sf_dir, "documents"), RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "score")
