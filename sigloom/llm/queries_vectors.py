"""Queries over ``embeddings`` and the turns of ``conversations``."""

from __future__ import annotations

from .centroids import cluster_report
from .prefix_trie import numbered_turns, prefix_trie, shared_openings
from .queries import query, table
from .shared import stored

CLUSTERS, ROUNDS = 40, 5


def _sql_rounds() -> str:
    """Every round as three tables: nearest centroid, floored means, all centroids."""
    near = "list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT"
    parts = []
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT v.r, min({near} * {CLUSTERS} + c.k) AS m FROM v, c{i} c GROUP BY v.r)"
        )
        if i < ROUNDS:
            parts.append(
                f"s{i} AS (SELECT m % {CLUSTERS} AS k, t.i, sum(q[t.i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) AS t(i) GROUP BY ALL)"
            )
            parts.append(
                f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{i} GROUP BY k)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (k))")
    return ",\n".join(parts)


SQL_CENTROIDS = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, q FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {CLUSTERS}),
{_sql_rounds()}
SELECT vec_id, (m % {CLUSTERS})::INTEGER AS cluster, m // {CLUSTERS} AS distance,
       (sum(m // {CLUSTERS}) OVER (PARTITION BY m % {CLUSTERS}))::BIGINT AS cluster_inertia,
       (sum(m // {CLUSTERS}) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} c ON c.k = m % {CLUSTERS}
"""


@query("op12_centroid_clusters", SQL_CENTROIDS)
def op12(spark, sf_dir):
    return cluster_report(table(spark, sf_dir, "embeddings"), clusters=CLUSTERS, rounds=ROUNDS).withColumnRenamed("id", "vec_id")


SQL_TRIE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM t),
bits AS (
  SELECT conv_id, list(CASE WHEN i < 0 THEN 4294967295 ELSE (ascii(substr(conv_id::VARCHAR, i // 8 + 1, 1)) >> (i % 8)) & 1 END ORDER BY i) AS b
  FROM (SELECT DISTINCT conv_id FROM t), range(-1, 160) AS s(i)
  WHERE i < 8 * length(conv_id::VARCHAR) GROUP BY conv_id),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(b, lambda x, y: xor(x >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295) % 6 AS h
  FROM bits),
turns AS (
  SELECT c.conv_id, 1 AS part, n.pos, n.id, n.text FROM c JOIN n ON n.conv_id = c.base WHERE n.pos <= h
  UNION ALL SELECT c.conv_id, 2, n.pos, n.id, n.text FROM c JOIN n USING (conv_id) WHERE n.pos > h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM turns),
path AS (
  SELECT conv_id, depth, length(text) AS chars,
         md5(string_agg(id, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
         md5(string_agg(id, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS up
  FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c),
nodes AS (
  SELECT node, depth, any_value(CASE WHEN depth = 1 THEN 'root' ELSE up END) AS parent, any_value(chars) AS chars,
         count(*) AS n_convs, min(conv_id) AS conv_id
  FROM path GROUP BY node, depth),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
w AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
sub AS (
  SELECT p.node, sum((w.n_convs - 1) * w.chars) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
  FROM w JOIN path p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.node),
ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY node)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM w LEFT JOIN nodes p ON p.node = w.parent JOIN sub ON sub.node = w.node LEFT JOIN ends ON ends.node = w.node
"""


@query("op13_prefix_trie", SQL_TRIE)
def op13(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(shared_openings(stored(numbered_turns(turns))))
