"""Dense row numbers and running totals over whole tables, without a one-task window.

Two ways to number rows:

* ``hash_ranked`` orders by a seeded md5. The leading hex digits are a
  uniform bucket, so one window per bucket plus a small table of bucket offsets
  numbers any group, hot or not. Nothing is written and the result does not depend on
  partitioning. The key must identify a row.
* ``sorted_table`` orders by any columns: one range exchange, one sorted table
  in the shared folder, and then the Parquet reader's own file name and row index
  give each row its place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..session import scratch_path


def attach(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on shared names, NULL matching NULL, keeping the left copy of the keys."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in cols])
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in cols])


def bucket_digits(df: DataFrame) -> int:
    """Hex digits that give at least eight buckets per shuffle partition (at most 16**5)."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = 1
    while 16**digits < 8 * partitions and digits < 5:
        digits += 1
    return digits


def hash_ranked(
    df: DataFrame,
    key: Sequence[str],
    seed: int,
    by: Sequence[str] = (),
    out: str = "row_index",
    digits: int | None = None,
) -> DataFrame:
    """Number rows 0, 1, … per ``by`` group in the order of md5(seed|key).

    A group holding a third of the table is still spread over every bucket. ``df`` is
    read twice, so write it first when it is costly to compute.
    """
    by = list(by)
    digits = digits or bucket_digits(df)
    # one never-null slot column: window and join then share a single exchange
    group = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in by]
    hashed = df.withColumn("__h", seeded_hash(seed, *key)).withColumn("__b", F.substring("__h", 1, digits))
    hashed = hashed.withColumn("__slot", F.concat_ws("\x1f", *group, "__b"))
    counts = hashed.groupBy(*by, "__b", "__slot").agg(F.count(F.lit(1)).alias("__n"))
    # At most 16**digits rows per group reach this window.
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__slot", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # rows with one key keep their order when a task is repeated
    within = Window.partitionBy("__slot").orderBy("__h", row_hash(df))
    return (
        hashed.withColumn("__i", F.row_number().over(within) - 1)
        .join(offsets, "__slot")
        .withColumn(out, (F.col("__off") + F.col("__i")).cast("bigint"))
        .drop("__h", "__b", "__slot", "__i", "__off")
    )


def sorted_table(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-sorted into a shared table, with ``__file`` and ``__pos`` per row.

    Ties are broken by a hash of the whole row, so that copies of an order key can
    be split between ranges.
    """
    spark = df.sparkSession
    schema = df.schema
    keyed = df.withColumn("__tie", row_hash(df))
    keys = [*order, "__tie"]
    if partitions:
        ranged = keyed.repartitionByRange(partitions, *keys)
    else:
        ranged = keyed.repartitionByRange(*keys)
    path = scratch_path(spark, "sorted")
    # one file per range, whatever the session's default is
    ranged.sortWithinPartitions(*keys).drop("__tie").write.option("maxRecordsPerFile", 0).parquet(path)
    table = spark.read.schema(schema).parquet(path)
    return table.select(
        "*",
        # files are named in range order
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("__file"),
        F.col("_metadata.row_index").alias("__pos"),
    )


def row_hash(df: DataFrame) -> Column:
    """A hash of every column that can be hashed."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema if f.dataType.typeName() not in ("map", "variant")])


def _file_offsets(table: DataFrame, value: Column, name: str) -> DataFrame:
    """Totals of all earlier ranges; one row per range, so safe for one task and for a broadcast."""
    totals = table.groupBy("__file").agg(value.alias("__v"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__file", F.coalesce(F.sum("__v").over(before), F.lit(0)).alias(name))


def with_global_index(df: DataFrame, order: Sequence[str], out: str = "row_index", partitions: int | None = None) -> DataFrame:
    """Number all rows 0, 1, … in the given order."""
    table = sorted_table(df, order, partitions)
    offsets = _file_offsets(table, F.count(F.lit(1)), "__off")
    return (
        table.join(F.broadcast(offsets), "__file")
        .withColumn(out, (F.col("__off") + F.col("__pos")).cast("bigint"))
        .drop("__file", "__pos", "__off")
    )


def running_totals(df: DataFrame, order: Sequence[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Sum of ``value`` over all rows up to and including this one."""
    table = sorted_table(df, order, partitions)
    offsets = _file_offsets(table, F.sum(value), "__off")
    upto = Window.partitionBy("__file").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        table.withColumn("__run", F.sum(value).over(upto))
        .join(F.broadcast(offsets), "__file")
        .withColumn(out, F.col("__off") + F.col("__run"))
        .drop("__file", "__pos", "__off", "__run")
    )
