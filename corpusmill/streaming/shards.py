"""Records to shards as files arrive."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shard import FATES, judged, quarantined_records
from ..sources.ranges import records_of, stream_files
from ..sources.records import TEXT_ENDINGS


def stream_shards(
    spark: SparkSession, path: str, out: str, checkpoint: str, fraction: float = 0.0, records_per_shard: int = 5000,
    seed: int = 42, chars: int = 2, rules="strict", endings=TEXT_ENDINGS, files_per_batch: int = 1000,
) -> None:
    """Write the shards of all files not seen before; the checkpoint remembers which were.

    A stream of file listings sets the batches, whose files are read in ranges, once. A batch goes to folders of its own number: ``out/batch=n`` for the
    shards, and below ``_quarantine`` (path, reason, text) and ``_totals`` (split, source, read, written, filtered,
    quarantined) alike. A batch that is run again writes the same folders over, so nothing is written twice.
    """

    def write(files: DataFrame, number: int) -> None:
        records = records_of(files, "ignore").withColumnRenamed("damage", "unread")
        told = judged(records, fraction, seed, chars, rules).persist(StorageLevel.MEMORY_AND_DISK)
        shards = told.where("fate = 'written'").select("path", "source", "text", "split").write.mode("overwrite")
        shards.option("maxRecordsPerFile", records_per_shard).partitionBy("split", "source").parquet(f"{out}/batch={number}")
        quarantined_records(told).drop("member").write.mode("overwrite").parquet(f"{out}/_quarantine/batch={number}")
        counts = [F.count_if(F.col("fate") == fate).alias(fate) for fate in FATES]
        totals = told.groupBy("split", "source").agg(F.count(F.lit(1)).alias("read"), *counts)
        totals.write.mode("overwrite").parquet(f"{out}/_totals/batch={number}")
        told.unpersist()

    files = stream_files(spark, path, endings, files_per_batch)
    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
