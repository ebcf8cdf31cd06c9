"""Draining a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import is_directory, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drain(stream: DataFrame, path: str, checkpoint: str, partition_by=(), fmt: str = "parquet", **options) -> None:
    """Process everything that has arrived, append it to ``path`` exactly once, then stop."""
    writer = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    for name, value in options.items():
        writer = writer.option(name, value)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start(path).awaitTermination()


def drained(stream: DataFrame, name: str, rocksdb: bool = False) -> DataFrame:
    """Drain into a fresh folder of the shared directory and read it back."""
    spark: SparkSession = stream.sparkSession
    base = scratch_path(spark, name)
    before = spark.conf.get(PROVIDER)
    if rocksdb:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        drain(stream, f"{base}/rows", f"{base}/checkpoint")
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def stream_table(spark: SparkSession, folder: str, table: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table, a single file or a directory of part files, as a stream of its files."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema  # fails when there is no such table
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_directory(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
