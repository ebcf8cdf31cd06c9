from __future__ import annotations

from .copies import exact_copies
from .registry import query, table

SQL = """
WITH plain AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
hashed AS (SELECT doc_id, sha256(t) AS text_sha256 FROM plain)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM hashed WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op13_exact_copies", SQL)
def op13_exact_copies(spark, folder):
    """Every document with the copy of it that stays."""
    return exact_copies(table(spark, folder, "documents").select("doc_id", "text"))
