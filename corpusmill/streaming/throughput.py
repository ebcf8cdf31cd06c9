"""Rows per time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant


def backlog_throughput(stream: DataFrame, path: str, checkpoint: str, time: str, keys: Sequence[str], width: str = "10 seconds") -> DataFrame:
    """Count and rate per window and key of everything that has arrived, in whatever order.

    Each batch writes its partial counts under its own number, so a repeated batch replaces them,
    and they are added up on reading. No row is late and no window stays open.
    """

    def add(batch: DataFrame, number: int) -> None:
        timed = batch.withColumn(time, instant(batch, time))
        part = timed.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("rows"))
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    seconds = F.unix_seconds(F.col("window.end")) - F.unix_seconds(F.col("window.start"))
    counted = stream.sparkSession.read.parquet(path).groupBy("window", *keys).agg(F.sum("rows").alias("rows"))
    return counted.select(
        F.col("window.start").alias("window_start"), *keys, "rows", (F.col("rows") / seconds).alias("rows_per_second")
    )


def throughput(stream: DataFrame, time: str, keys: Sequence[str], width: str = "10 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Count and rate per closed window and key; a window is emitted once the watermark passes it."""
    seconds = F.unix_seconds(F.col("window.end")) - F.unix_seconds(F.col("window.start"))
    counted = (
        stream.withColumn(time, instant(stream, time))
        .withWatermark(time, lateness)
        .groupBy(F.window(time, width), *keys)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return counted.select(
        F.col("window.start").alias("window_start"), *keys, "rows", (F.col("rows") / seconds).alias("rows_per_second")
    )
