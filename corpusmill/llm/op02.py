from __future__ import annotations

from .registry import query, table
from .repeats import removed

SIZE = 400

# Two hex digits a byte: every window's digest, those that start twice, and the runs that they cover.
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * SIZE})) AS m FROM (SELECT r, h, unnest(range(0, n - {SIZE - 1})) AS i FROM d)),
twice AS (SELECT r, i FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
opens AS (SELECT r, i, CAST(i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + {SIZE}, -1) AS INT) AS fresh FROM twice),
runs AS (
  SELECT r, min(i) AS s, max(i) + {SIZE} AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM opens) GROUP BY r, run),
cut AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM runs),
kept AS (
  SELECT r, sum(e - s) AS removed, count(*) AS spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS front
  FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query("op2_repeats", SQL)
def op2_repeats(spark, folder):
    """What is left of every document without its repeated strings of 400 bytes."""
    return removed(table(spark, folder, "documents").select("doc_id", "text"), size=SIZE)
