"""Per-key ordered computation that survives hot keys.

A window partitioned by key gives one key to one task. These helpers first count
rows per key. When no key exceeds ``hot_rows`` the plain window is used. Otherwise
the hot keys leave the window: their rows are numbered by a range sort and cut into
equal segments, and each segment gets copies of the few rows it needs from the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .index import attach, with_global_index

HOT_ROWS = 1_000_000


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame | None, DataFrame]:
    """(rows of hot keys or None, all other rows), after one counting pass over the key columns.

    Any number of keys may be hot; they are a written table, joined as Spark sees fit. With hot keys ``df`` is read
    twice more, so write it first when it is costly to compute.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    hot_keys = materialize(counts.drop("__n"), "hot_keys")
    if hot_keys.isEmpty():
        return None, df
    return attach(df, hot_keys, keys, "left_semi"), attach(df, hot_keys, keys, "left_anti")


def _hot_ranked(hot: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, extras: Mapping[str, Column]) -> DataFrame:
    indexed = with_global_index(hot, [*keys, *order], "__g")
    groups = indexed.groupBy(*keys).agg(F.min("__g").alias("__g0"), *[c.alias(n) for n, c in extras.items()])
    return (
        attach(indexed, groups, keys)
        .withColumn(out, F.col("__g") - F.col("__g0") + 1)
        .drop("__g", "__g0")
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "rn",
    extras: Mapping[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based row number per key, plus whole-group aggregates named by ``extras``."""
    extras = dict(extras or {})
    columns = [*df.columns, out, *extras]
    hot, cold = split_hot(df, keys, hot_rows)
    whole = Window.partitionBy(*keys)
    result = cold.withColumn(out, F.row_number().over(whole.orderBy(*order)).cast("bigint"))
    for name, aggregate in extras.items():
        result = result.withColumn(name, aggregate.over(whole))
    result = result.select(*columns)
    if hot is not None:
        result = result.unionByName(_hot_ranked(hot, keys, order, out, extras).select(*columns))
    return result


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lead_in: int,
    compute: Callable[[DataFrame, list[str]], DataFrame],
    hot_rows: int = HOT_ROWS,
    extras: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Apply ``compute(df, partition_columns)`` whose windows look back at most ``lead_in`` rows.

    ``compute`` also finds ``__rn``, the row number within the whole key, and the
    whole-group aggregates of ``extras``; both are dropped from the result.
    """
    if lead_in >= hot_rows:
        raise ValueError("a segment must be longer than the rows it looks back on")
    keys, extras = list(keys), dict(extras or {})
    hot, cold = split_hot(df, keys, hot_rows)
    whole = Window.partitionBy(*keys)
    aggregates = {name: aggregate.over(whole) for name, aggregate in extras.items()}
    numbered = cold.withColumns({"__rn": F.row_number().over(whole.orderBy(*order)).cast("bigint"), **aggregates})
    result = compute(numbered, keys).drop("__rn", *extras)
    if hot is None:
        return result
    numbered = _hot_ranked(hot, keys, order, "__rn", extras).withColumn("__i", F.col("__rn") - 1)
    own = F.floor(F.col("__i") / hot_rows).cast("bigint")
    # the last rows of a segment also open the next one
    copies = F.when(F.pmod("__i", F.lit(hot_rows)) >= hot_rows - lead_in, F.array(own, own + 1)).otherwise(F.array(own))
    segments = numbered.withColumn("__own", own).withColumn("__seg", F.explode(copies))
    done = compute(segments, [*keys, "__seg"]).where(F.col("__seg") == F.col("__own"))
    return result.unionByName(done.select(*result.columns))
