from __future__ import annotations

from .jaccard import similar
from .registry import query, table

SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT words, min(doc_id) AS class_id FROM w GROUP BY words),
s AS (SELECT class_id, unnest(list_distinct(CASE WHEN len(words) BETWEEN 1 AND 4 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingle FROM c),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
met AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.class_id <> b.class_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.class_id = a JOIN n y ON y.class_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
reach AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(counts.n, 0) AS n_links, root AS component_id, root = doc_id AS kept
FROM w JOIN c USING (words) JOIN roots ON roots.a = class_id LEFT JOIN counts ON counts.a = class_id
"""


@query("op3_jaccard_join", SQL)
def op3_jaccard_join(spark, folder):
    """Every document with its class, its links and its group of similar documents."""
    return similar(table(spark, folder, "documents").select("doc_id", "text"))
