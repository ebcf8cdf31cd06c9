from __future__ import annotations

from .neighbours import near_duplicates
from .registry import query, table

# All pairs: for tables of some thousand vectors.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, root = vec_id AS kept
FROM embeddings JOIN roots ON roots.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""


@query("op9_near_vectors", SQL)
def op9_near_vectors(spark, folder):
    """Every vector with its links and its group of near duplicates."""
    return near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding"))
