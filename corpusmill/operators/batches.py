"""Fixed-size batches per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import HOT_ROWS, ranked


def assign_batches(
    df: DataFrame, file: str, order: Sequence[str], size: int, pad: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds ``batch_id, slot, source_index``; with ``pad`` the last batch is filled to ``size``.

    Padding repeats the last rows of the batch when it has enough of them, else the
    batch from its start, over and over. Padding rows have ``source_index`` −1.
    """
    numbered = ranked(df, [file], order, "__rn", {"__n": F.count(F.lit(1))}, hot_rows)
    i = F.col("__rn") - 1
    placed = numbered.withColumns({"__i": i, "batch_id": F.floor(i / size).cast("bigint"), "__slot": F.pmod(i, F.lit(size))})
    if not pad:
        return placed.withColumns({"slot": F.col("__slot"), "source_index": F.col("__i")}).drop("__rn", "__n", "__i", "__slot")
    filled = F.pmod(F.col("__n"), F.lit(size))  # rows in a short last batch, 0 if none is short
    need = F.lit(size) - filled
    short = (filled > 0) & (F.col("batch_id") == F.floor(F.col("__n") / size))
    tail = F.when(F.col("__slot") >= filled - need, F.array(F.col("__slot") + need))
    cyclic = F.when(F.col("__slot") + filled < size, F.sequence(F.col("__slot") + filled, F.lit(size - 1).cast("bigint"), filled))
    extra = F.when(short, F.when(filled >= need, tail).otherwise(cyclic))
    slots = F.concat(F.array(F.col("__slot")), F.coalesce(extra, F.array().cast("array<bigint>")))
    spread = placed.withColumn("slot", F.explode(slots))
    source = F.when(F.col("slot") == F.col("__slot"), F.col("__i")).otherwise(F.lit(-1))
    return spread.withColumn("source_index", source.cast("bigint")).drop("__rn", "__n", "__i", "__slot")
