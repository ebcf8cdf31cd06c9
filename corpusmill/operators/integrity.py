"""Did a rewrite keep every row? Sums, counts and shapes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checksums(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: count, a double sum per numeric or boolean column, and an order-free row hash.

    The row hash also notices values that moved between rows, which column sums miss.
    """
    names = sorted(columns or df.columns)
    sums = []
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, T.NumericType):
            sums.append(F.sum(F.col(name).cast("double")).alias(f"sum_{name}"))
        elif isinstance(kind, T.BooleanType):
            sums.append(F.sum(F.col(name).cast("int").cast("double")).alias(f"sum_{name}"))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            inner = F.aggregate(F.col(name).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
            sums.append(F.sum(inner).alias(f"sum_{name}"))
    row_hash = F.sum(F.xxhash64(*[F.col(n) for n in names]).cast("decimal(20,0)")).alias("row_hash")
    return df.agg(F.count(F.lit(1)).alias("rows"), *sums, row_hash)


def assert_same(before: DataFrame, after: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> None:
    """Raise unless both tables have the same rows, in any order."""
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError(f"columns differ: {sorted(before.columns)} and {sorted(after.columns)}")
    a, b = checksums(before).first().asDict(), checksums(after).first().asDict()
    for name, value in a.items():
        other = b[name]
        if isinstance(value, float) and isinstance(other, float):
            equal = math.isclose(value, other, rel_tol=rtol, abs_tol=atol) or (math.isnan(value) and math.isnan(other))
        else:
            equal = value == other
        if not equal:
            raise ValueError(f"{name} changed from {value} to {other}")


def shape_report(df: DataFrame, arrays: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Smallest and largest array size per group, and whether each column is uniform."""
    stats = []
    for name in arrays:
        stats += [F.min(F.size(name)).alias(f"min_{name}"), F.max(F.size(name)).alias(f"max_{name}")]
    uniform = F.lit(True)
    for name in arrays:
        uniform = uniform & (F.col(f"min_{name}") == F.col(f"max_{name}"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *stats).withColumn("uniform", uniform)
