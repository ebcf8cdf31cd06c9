"""A metric table that grows while a job reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def log_metrics(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append each batch under its own folder: a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
