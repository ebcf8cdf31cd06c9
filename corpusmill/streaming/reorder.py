"""Rows that arrive late or out of order: held back until their turn, or set aside and counted.

A batch moves the mark to its latest time less the lateness that is allowed. Rows before the mark are in order and
final, later ones wait in a table for the next batch, and a row that comes when the mark has
passed it goes to a table of late rows. Everything is written under the number of its batch, so a batch
that is run again writes the same tables over.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.instants import instant, micros
from ..operators.groups import HOT_ROWS
from ..operators.index import attach
from ..operators.sequence import prior_occurrences
from ..session import materialize, path_exists

FAN = 16  # tables of counts that are merged into one of the next level


def merged_numbers(n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, number) of the count tables that together cover the batches before ``n``, few of each level."""
    found, level = [], 0
    while n:
        n, rest = divmod(n, fan)
        found += [(level, n * fan + k) for k in range(rest)]
        level += 1
    return found


def counts_before(spark: SparkSession, path: str, n: int) -> DataFrame | None:
    tables = [spark.read.parquet(f"{path}/counts/level={level}/no={no}") for level, no in merged_numbers(n)]
    return reduce(DataFrame.unionByName, tables) if tables else None


def write_counts(own: DataFrame, path: str, n: int, group: Sequence[str], fan: int = FAN) -> None:
    """The counts of batch ``n``, and the sums of each level that it completes."""
    spark, level, no = own.sparkSession, 0, n
    own.write.mode("overwrite").parquet(f"{path}/counts/level=0/no={n}")
    while (no + 1) % fan == 0:
        parts = [f"{path}/counts/level={level}/no={k}" for k in range(no + 1 - fan, no + 1)]
        level, no = level + 1, no // fan
        merged = spark.read.parquet(*parts).groupBy(*group).agg(F.sum("n").alias("n"))
        merged.write.mode("overwrite").parquet(f"{path}/counts/level={level}/no={no}")


class OrderedRepetitions:
    """``rep_count`` of rows that may come in another batch than their time says.

    Below ``path``: ``rows`` (final, with their counts), ``pending``, ``late`` (with the mark that had passed; rows without a time as
    well), ``counts`` and ``marks``. Rows of one time are in the order of ``order``. ``finish`` takes
    the rows that still wait when no more will come.
    """

    def __init__(self, key: Sequence[str], state: Sequence[str], time: str, order: Sequence[str], lateness: int, path: str, hot_rows: int = HOT_ROWS):
        self.key, self.state, self.time, self.order = list(key), list(state), time, list(order)
        self.lateness, self.path, self.hot_rows = lateness * 1_000_000, path, hot_rows

    def mark(self, spark: SparkSession, n: int) -> int | None:
        if n == 0:
            return None
        return spark.read.parquet(f"{self.path}/marks/batch={n - 1}").first()[0]

    def take(self, batch: DataFrame, n: int, last: bool = False) -> None:
        spark, passed = batch.sparkSession, self.mark(batch.sparkSession, n)
        timed = materialize(batch.withColumn("__t", micros(batch, self.time)), "batch")
        latest = timed.agg(F.max("__t")).first()[0]
        mark = max((m for m in (passed, None if latest is None else latest - self.lateness) if m is not None), default=None)
        too_late = F.col("__t").isNull() if passed is None else F.col("__t").isNull() | (F.col("__t") < passed)
        rows = timed.where(~too_late)
        if n:
            rows = rows.unionByName(spark.read.schema(timed.schema).parquet(f"{self.path}/pending/batch={n - 1}"))
        ready = F.lit(True) if last else F.lit(False) if mark is None else F.col("__t") < mark
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={n}")
        write(timed.where(too_late).withColumn("passed", F.lit(passed).cast("bigint")).drop("__t"), "late")
        write(rows.where(~ready), "pending")
        self.number(rows.where(ready), n)
        write(spark.range(1).select(F.lit(mark).cast("bigint").alias("mark")), "marks")

    def number(self, rows: DataFrame, n: int) -> None:
        group = [*self.key, *self.state]
        rows = materialize(rows, "ready")
        own = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        numbered = prior_occurrences(rows, self.key, self.state, ["__t", *self.order], self.hot_rows)
        earlier = counts_before(rows.sparkSession, self.path, n)
        if earlier is not None:
            before = attach(earlier, own.select(*group), group, "left_semi").groupBy(*group).agg(F.sum("n").alias("before"))
            numbered = attach(numbered, before, group, "left")
            numbered = numbered.withColumn("rep_count", F.col("rep_count") + F.coalesce("before", F.lit(0)))
        found = numbered.select(*[c for c in rows.columns if c != "__t"], F.col("rep_count").cast("bigint").alias("rep_count"))
        found.write.mode("overwrite").parquet(f"{self.path}/rows/batch={n}")
        write_counts(own, self.path, n, group)

    def drain(self, stream: DataFrame, checkpoint: str) -> None:
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def finish(self, spark: SparkSession) -> None:
        n = 0
        while path_exists(spark, f"{self.path}/marks/batch={n}"):
            n += 1
        if n:
            waiting = spark.read.parquet(f"{self.path}/pending/batch={n - 1}")
            self.take(waiting.drop("__t").where("false"), n, last=True)


def late_throughput(
    stream: DataFrame, path: str, checkpoint: str, time: str, keys: Sequence[str], width: str = "10 seconds", lateness: int = 10
) -> DataFrame:
    """Per window and key: ``rows`` in time, ``late_rows`` that came when the window had closed, and whether it has.

    A window closes when the latest time seen, less ``lateness`` seconds, reaches its end. Each batch writes its counts
    and its latest time under its own number; every row is in one of the two counts, those without a time in
    the first, under no window.
    """

    def add(batch: DataFrame, n: int) -> None:
        timed = batch.withColumn("__i", instant(batch, time))
        counts = timed.where("__i IS NOT NULL").groupBy(F.window("__i", width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))
        untimed = timed.where("__i IS NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        untimed = untimed.withColumn("window", F.lit(None).cast(counts.schema["window"].dataType))
        counts.unionByName(untimed).write.mode("overwrite").parquet(f"{path}/counts/batch={n}")
        timed.agg(F.max("__i").alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch={n}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # one row per batch
    marks = spark.read.parquet(f"{path}/marks")
    at_last = marks.agg(F.max("latest")).first()[0]
    allowed = F.expr(f"INTERVAL {int(lateness)} SECONDS")
    passed = marks.select("batch", (F.max("latest").over(before) - allowed).alias("passed"))
    counts = spark.read.parquet(f"{path}/counts").join(passed, "batch")
    late = F.coalesce(F.col("window.end") <= F.col("passed"), F.lit(False))
    summed = counts.groupBy("window", *keys).agg(
        F.sum(F.when(late, 0).otherwise(F.col("n"))).alias("rows"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("late_rows")
    )
    closed = F.col("window.end") <= F.lit(at_last).cast("timestamp") - allowed
    return summed.select(F.col("window.start").alias("window_start"), *keys, "rows", "late_rows", closed.alias("closed"))
