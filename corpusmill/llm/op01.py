from __future__ import annotations

import public_tokenizers

from .packing import pack
from .registry import query, table

SIZE, LAST_ID = 2048, 1


def tokenizer_spec(path: str | None = None) -> str:
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@query("op1_packing")
def op1_packing(spark, folder):
    """All documents packed into sequences of 2,048 tokens, with a checksum in place of each piece's ids."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_spec(), SIZE, LAST_ID).drop("row_id", "ids")
