"""Repetition counts while rows arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.groups import HOT_ROWS
from ..operators.index import attach
from ..operators.sequence import prior_occurrences
from ..session import path_exists

BUCKETS = 1024
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def stream_repetitions(
    stream: DataFrame, key: Sequence[str], state: Sequence[str], order: Sequence[str], ttl_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """``rep_count``: earlier rows with the same key and state, across batches.

    Groups of one key and state are dealt by hash to ``buckets``, so a busy key spreads over its states,
    and Python is called once per bucket and batch. The state holds one count per group, of which a
    batch reads and writes those that occur in it. ``buckets`` is part of the checkpoint: keep it.
    Rows of a group must not arrive in an earlier batch than rows before them; within a
    batch they are sorted, which holds one bucket's share of one batch in memory: the
    reader's files-per-trigger bounds it. For groups too large for that use
    ``log_repetitions``. ``ttl_ms`` drops the state of groups that went quiet.
    """
    order, columns, group = list(order), stream.columns, [*key, *state]

    # local, so that it travels to the workers by value
    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getMapState("seen", "name string", "n bigint", ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows), ignore_index=True).sort_values(order)
            names = batch["repetition_group"]
            counts = names.value_counts()
            known = self.seen.exists()
            before = {}
            for name, n in counts.items():
                seen = self.seen.getValue((name,)) if known else None
                before[name] = seen[0] if seen else 0
                self.seen.updateValue((name,), (before[name] + int(n),))
            batch["rep_count"] = batch.groupby(names).cumcount() + names.map(before)
            yield batch[[*columns, "rep_count"]]

        def close(self) -> None:
            pass

    schema = T.StructType([*stream.schema.fields, T.StructField("rep_count", T.LongType())])
    named = stream.withColumn("repetition_group", group_name(stream, group))
    dealt = named.withColumn("repetition_bucket", F.pmod(F.xxhash64("repetition_group"), F.lit(buckets)))
    return dealt.groupBy("repetition_bucket").transformWithStateInPandas(
        statefulProcessor=Counter(),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def group_name(rows: DataFrame, group: Sequence[str]) -> Column:
    """The values of ``group`` as JSON, equal where ``groupBy`` finds them equal; never null."""
    kinds = {f.name: f.dataType for f in rows.schema}
    # -0.0 and 0.0 are one group
    values = [F.col(c) + F.lit(0.0) if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else F.col(c) for c in group]
    options = {"ignoreNullFields": "false", "timestampFormat": MICROS + "XXX", "timestampNTZFormat": MICROS}
    return F.to_json(F.struct(*[v.alias(f"c{k}") for k, v in enumerate(values)]), options)


def log_repetitions(
    stream: DataFrame,
    key: Sequence[str],
    state: Sequence[str],
    order: Sequence[str],
    path: str,
    checkpoint: str,
    hot_rows: int = HOT_ROWS,
) -> None:
    """The same counts for groups of any size, written under ``path/rows``.

    Each batch is numbered by the batch operator, which splits hot groups, on top of the
    counts that earlier batches left under ``path/counts``. Both are written per batch
    number, so a repeated batch replaces itself.
    """
    group = [*key, *state]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        numbered = prior_occurrences(batch, key, state, order, hot_rows)
        if path_exists(spark, f"{path}/counts"):
            earlier = spark.read.parquet(f"{path}/counts").where(F.col("batch") < batch_id)
            # only groups that occur again are summed up
            before = attach(earlier, own.select(*group), group, "left_semi").groupBy(*group).agg(F.sum("n").alias("before"))
            numbered = attach(numbered, before, group, "left")
            numbered = numbered.withColumn("rep_count", F.col("rep_count") + F.coalesce("before", F.lit(0)))
        rows = numbered.select(*batch.columns, F.col("rep_count").cast("bigint").alias("rep_count"))
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        own.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
