"""Counts, shares and their comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Classes 0, 1, 2 of the outcome target.
OUTCOME_LABELS = ("Loss", "Draw", "Win")


def group_totals(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str] | None = None) -> DataFrame:
    """Rows per group and distinct counts named by ``distinct``."""
    counts = [F.count_distinct(column).alias(name) for name, column in (distinct or {}).items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *counts)


def rollup_totals(df: DataFrame, keys: Sequence[str], cube: bool = False) -> DataFrame:
    """Rows per group, subtotals and the grand total, told apart by ``level`` from grouping_id."""
    grouped = df.cube(*keys) if cube else df.rollup(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().cast("bigint").alias("level"))


def category_distribution(df: DataFrame, column: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count and share of classes 0, 1, … named by ``labels``; empty input gives 0.

    All classes are counted in one aggregation; the share is of all rows.
    """
    cells = [
        F.struct(
            F.lit(code).cast("bigint").alias("code"),
            F.lit(label).alias("category"),
            F.count_if(F.col(column) == code).alias("rows"),
        )
        for code, label in enumerate(labels)
    ]
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__total"), F.array(*cells).alias("__cells"))
    flat = totals.select(*by, "__total", F.inline("__cells"))
    share = F.when(F.col("__total") > 0, F.col("rows") / F.col("__total")).otherwise(F.lit(0.0))
    return flat.withColumn("share", share).drop("__total")


def plane_usage(df: DataFrame, column: str, planes: int, kind: str = "index") -> DataFrame:
    """Share of each plane 0..planes−1 in the total; a zero total gives zeros.

    ``index``: a flat ``plane * 64 + square`` index per row. ``dense``: an array of
    ``planes`` numbers per row. ``full``: an array of 64 numbers per plane. A plane outside the range is an error.
    """
    if kind == "index":
        used = df.where(F.col(column).isNotNull()).select(
            F.floor(F.col(column) / 64).cast("bigint").alias("plane"), F.lit(1.0).alias("__x")
        )
    elif kind in ("dense", "full"):
        used = df.select(F.posexplode(F.col(column)).alias("__p", "__v"))
        place = F.col("__p") if kind == "dense" else F.floor(F.col("__p") / 64)
        used = used.select(place.cast("bigint").alias("plane"), F.col("__v").cast("double").alias("__x"))
    else:
        raise ValueError("kind is index, dense or full")
    wrong = F.raise_error(F.concat(F.lit(f"not one of {planes} planes: "), F.col("plane").cast("string")))
    used = used.withColumn("plane", F.when(F.col("plane").between(0, planes - 1), F.col("plane")).otherwise(wrong))
    sums = used.groupBy("plane").agg(F.sum("__x").alias("__x"))
    every = df.sparkSession.range(planes).select(F.col("id").alias("plane"))
    filled = every.join(sums, "plane", "left").withColumn("usage", F.coalesce("__x", F.lit(0.0)))
    # one row per plane
    total = F.sum("usage").over(Window.partitionBy())
    return filled.select("plane", "usage", F.when(total > 0, F.col("usage") / total).otherwise(0.0).alias("share"))


def compare_distributions(a: DataFrame, b: DataFrame, category: str, share: str = "share") -> DataFrame:
    """Both shares side by side, 0 where a category is missing."""
    left = a.select(F.col(category), F.col(share).alias("share_a"))
    right = b.select(F.col(category), F.col(share).alias("share_b"))
    joined = left.join(right, category, "full_outer")
    a0, b0 = F.coalesce("share_a", F.lit(0.0)), F.coalesce("share_b", F.lit(0.0))
    return joined.select(category, a0.alias("share_a"), b0.alias("share_b"), (a0 - b0).alias("difference"))


def progress(df: DataFrame, step: str, elapsed: str, total) -> DataFrame:
    """Percent done, and seconds left at the average pace so far."""
    end = F.lit(total) if not hasattr(total, "cast") else total
    eta = F.when((F.col(step) > 0) & (F.col(elapsed) > 0), (end - F.col(step)) * F.col(elapsed) / F.col(step))
    return df.withColumns(
        {"progress_pct": F.when(end > 0, F.col(step) * 100.0 / end).otherwise(F.lit(0.0)), "eta_seconds": eta}
    )


def pace(df: DataFrame, rows: str, seconds: str, workers: str, files: str) -> DataFrame:
    """Rows per second, per worker-second and per file of finished runs; NULL where nothing elapsed."""

    def rate(divisor):
        return F.when(divisor > 0, F.col(rows) / divisor)

    return df.withColumns(
        {
            "rows_per_second": rate(F.col(seconds)),
            "rows_per_worker_second": rate(F.col(seconds) * F.col(workers)),
            "rows_per_file": rate(F.col(files)),
        }
    )
