from __future__ import annotations

import public_tokenizers

from .pieces import digests
from .registry import query, table


def model_bytes(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@query("op7_pieces")
def op7_pieces(spark, folder):
    """Every document encoded and decoded."""
    return digests(table(spark, folder, "documents").select("doc_id", "text"), model_bytes())
