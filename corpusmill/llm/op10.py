from __future__ import annotations

from .private import pseudonymise
from .registry import query, table

#: Where the caller's key is set; the fallback suits tables that hold no real person's data.
KEY_SETTING = "spark.corpusmill.pseudonymKey"
KEY = "corpus"


@query("op10_pseudonyms")
def op10_pseudonyms(spark, folder):
    """Every document with its personal data under pseudonyms."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonymise(docs, spark.conf.get(KEY_SETTING, KEY))
