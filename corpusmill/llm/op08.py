from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .warc import archive_pages, read_warc

# Five hex digits of the digest are four letters of base 32.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * i, 5) AS BIGINT) >> b) & 31 AS INT), 1)), '')), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""


@query("op8_arc_to_warc", SQL)
def op8_arc_to_warc(spark, folder):
    """Every page as a record of a WARC archive, read back from it."""
    path = archive_pages(table(spark, folder, "pages"), least=0)
    columns = "source_id bigint, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"
    records = read_warc(spark, path, columns)
    return records.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
