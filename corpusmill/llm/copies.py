"""Operator 13: exact copies of texts, with frequent digests split off, by DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Spark's ``freqItems``, the frequent
elements algorithm of Misra and Gries in its form by Karp, Shenker and Papadimitriou, names the digests that may stand
in more than ``SUPPORT`` of all rows, at most ``1 / SUPPORT`` of them. Their groups are counted
exactly, and the verified winners are broadcast: rows of such digests are settled where they are
read. All other digests go through an ordinary shuffle, where no group is large.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Share of all rows from which a digest counts as frequent; the broadcast tables hold 1 / SUPPORT rows at most.
SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Written rows of ``key``, ``__digest`` and the order of rows within a group.

    The largest key is first, then the raw text's hash and a number of the row: of rows that
    repeat the largest key exactly one is the first.
    """
    rank = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("raw"), F.monotonically_increasing_id().alias("row"))
    return materialize(
        docs.select(F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("__digest"), rank.alias("__rank")), "digests"
    )


def winners(rows: DataFrame) -> DataFrame:
    """The row that stays and the number of rows, per digest."""
    return rows.groupBy("__digest").agg(F.max("__rank").alias("__best"), F.count(F.lit(1)).alias("__n"))


def frequent(rows: DataFrame, support: float) -> DataFrame:
    """Verified winners of the digests that Misra-Gries counters still hold after one pass."""
    held = rows.stat.freqItems(["__digest"], support).select(F.explode("__digest_freqItems").alias("__digest"))
    held = F.broadcast(materialize(held, "frequent"))  # 1 / support rows at most
    counted = winners(rows.join(held, "__digest", "left_semi"))
    return materialize(counted.where("__n > 1"), "verified")


def settled(rows: DataFrame, support: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of frequent digests, other rows, winners of the others), the first with their winners."""
    heavy = F.broadcast(frequent(rows, support))
    rest = rows.join(heavy.select("__digest"), "__digest", "left_anti")
    return rows.join(heavy, "__digest"), rest, winners(rest)


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: ``key, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest key stays; null keys are the smallest, and of rows that
    repeat the key exactly one is ``kept``. Null text is empty, and empty texts are equal. Texts
    are read whole, once. Other columns are ignored; an empty table has no rows.
    """
    heavy, rest, light = settled(digests(docs, key, text), support)
    found = heavy.unionByName(rest.join(light, "__digest"))
    return found.select(
        F.col("__rank.key").alias(key),
        F.col("__best.key").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col("__rank.row") == F.col("__best.row")).alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of frequent texts are removed where they are read, so only the winners among them are moved.
    Cases are settled as by ``exact_copies``; of rows that repeat key and text, and differ in other
    columns, one stays.
    """
    names = docs.columns
    rows = digests(docs, key, text)
    verified = frequent(rows, support)
    heavy = F.broadcast(verified)
    light = winners(rows.join(heavy.select("__digest"), "__digest", "left_anti"))
    # the whole row is one column, so that none of its names can clash
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"),
        F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("__digest"),
        F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("raw")).alias("__mine"),
    )
    best = [F.col("__best.key").alias("key"), F.col("__best.raw").alias("raw")]
    first = lambda table: table.select(F.col("__digest"), F.struct(*best).alias("__first"))
    is_first = F.col("__mine").eqNullSafe(F.col("__first"))
    from_heavy = whole.join(F.broadcast(first(verified)), "__digest").where(is_first)
    others = whole.join(F.broadcast(verified.select("__digest")), "__digest", "left_anti")
    from_light = others.join(first(light), "__digest").where(is_first)
    kept = from_heavy.unionByName(from_light).groupBy("__digest").agg(F.first("__row").alias("__row"))
    return kept.select("__row.*")
