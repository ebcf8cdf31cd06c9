"""Ordered computation per key: positions, repetitions, rolling means and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import micros
from .groups import HOT_ROWS, ranked, windowed
from .index import row_hash

FEWER = 16  # heats whose winners meet in the next one


def sequence_targets(df: DataFrame, key: Sequence[str], order: Sequence[str], cap: int = 512, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``ply`` from 0, ``total_plys`` per key, ``ply_target`` = steps left, at most ``cap``."""
    numbered = ranked(df, key, order, "__rn", {"total_plys": F.count(F.lit(1))}, hot_rows)
    left = F.greatest(F.lit(0), F.col("total_plys") - F.col("__rn"))
    return numbered.withColumns({"ply": F.col("__rn") - 1, "ply_target": F.least(left, F.lit(cap))}).drop("__rn")


def prior_occurrences(
    df: DataFrame, key: Sequence[str], state: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """How often the row's state occurred earlier under its key, and the flags ≥ 1 and ≥ 2."""
    numbered = ranked(df, [*key, *state], order, "__rn", None, hot_rows)
    return numbered.withColumns(
        {
            "rep_count": F.col("__rn") - 1,
            "rep_count_ge1": F.col("__rn") >= 2,
            "rep_count_ge2": F.col("__rn") >= 3,
        }
    ).drop("__rn")


def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int = 1000,
    out: str = "rolling_mean", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mean of the last ``window`` values of a series."""

    def compute(rows: DataFrame, partition: list[str]) -> DataFrame:
        frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(window - 1), 0)
        return rows.withColumn(out, F.avg(value).over(frame))

    return windowed(df, keys, order, window - 1, compute, max(hot_rows, window))


def step_rates(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows per second since the previous row and since the start; no elapsed time gives NULL."""

    def compute(rows: DataFrame, partition: list[str]) -> DataFrame:
        w = Window.partitionBy(*partition).orderBy(*order)
        gap = (F.col("__micros") - F.lag("__micros").over(w)) / 1e6
        since = (F.col("__micros") - F.col("__start")) / 1e6
        return rows.withColumns(
            {
                "recent_rate": F.when(gap > 0, 1.0 / gap),
                "average_rate": F.when(since > 0, F.col("__rn") / since),
            }
        )

    timed = df.withColumn("__micros", micros(df, time))
    return windowed(timed, keys, order, 1, compute, hot_rows, {"__start": F.min("__micros")}).drop("__micros")


def every_nth(df: DataFrame, step: str, n: int) -> DataFrame:
    """Rows whose 1-based step is a multiple of ``n``."""
    return df.where(F.pmod(F.col(step), F.lit(n)) == 0)


#: Spark keeps each task's first rows before the exchange up to this number.
TASK_LIMIT = 1000


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 6) -> DataFrame:
    """The first ``n`` rows per key; a task never holds a large group, whatever ``n`` is.

    Up to ``TASK_LIMIT`` each task keeps only its own first ``n`` before the exchange. Above it rows meet in heats:
    each key's rows are dealt over as many heats as there are partitions, then over ever fewer, and the
    first ``n`` of a heat go on. Rows that tie in ``order`` are told apart by a hash of the whole row.
    """
    names, tie = df.columns, [*order, "__tie"]
    left = df.withColumn("__tie", row_hash(df))
    heats = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n > TASK_LIMIT else 1
    while True:
        w = Window.partitionBy(*keys, *(["__heat"] if heats > 1 else [])).orderBy(*tie)
        dealt = left.withColumn("__heat", F.pmod(F.xxhash64("__tie", F.lit(heats)), F.lit(heats))) if heats > 1 else left
        left = dealt.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).select(*names, "__tie")
        if heats == 1:
            return left.select(*names)
        heats = heats // FEWER if heats >= 2 * FEWER else 1
