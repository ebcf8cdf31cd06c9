"""Queries that run as streams and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import chosen_suffixes
from ..operators.sequence import rolling_mean
from ..session import scratch_path
from ..streaming.metric_log import log_metrics
from ..streaming.reorder import OrderedRepetitions, late_throughput
from ..streaming.repetition import log_repetitions, stream_repetitions
from ..streaming.run import drained, stream_table
from ..streaming.shards import stream_shards
from ..streaming.throughput import backlog_throughput
from .records import WRITTEN, rendered
from .registry import literals, query
from .sequences import REPETITION, ROLLING

WINDOWS = """
WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type, count(*) AS rows FROM events GROUP BY ALL)
SELECT epoch_us(s) AS window_start, event_type, rows, round(rows / 3600.0, 6) AS rows_per_second FROM w"""


@query("stream_directory_table", "SELECT event_id, event_type FROM events")
def stream_directory_table(spark, folder):
    """The events written as several part files, and streamed."""
    base = scratch_path(spark, "directory")
    spark.read.parquet(f"{folder}/events.parquet").repartition(5).write.parquet(f"{base}/events.parquet")
    return drained(stream_table(spark, base, "events", files_per_batch=2), "directory").select("event_id", "event_type")


@query("stream_throughput", WINDOWS)
def stream_throughput(spark, folder):
    """Several files whose rows are not in the order of their time, a file per batch."""
    base = scratch_path(spark, "throughput")
    spark.read.parquet(f"{folder}/events.parquet").repartition(4).write.parquet(f"{base}/events.parquet")
    stream = stream_table(spark, base, "events", files_per_batch=1)
    rows = backlog_throughput(stream, f"{base}/counts", f"{base}/checkpoint", "ts", ["event_type"], "1 hour")
    return rows.select(
        F.unix_micros("window_start").alias("window_start"), "event_type", "rows", F.round("rows_per_second", 6).alias("rows_per_second")
    )


@query("stream_repetitions", REPETITION)
def stream_repetition_query(spark, folder):
    counted = stream_repetitions(stream_table(spark, folder, "events"), ["user_id"], ["event_type"], ["ts", "event_id"])
    rows = drained(counted, "repetitions", rocksdb=True)
    return rows.select("event_id", "rep_count", (F.col("rep_count") >= 1).alias("rep_count_ge1"), (F.col("rep_count") >= 2).alias("rep_count_ge2"))


@query("stream_repetitions_hot_groups", REPETITION)
def stream_repetition_log(spark, folder):
    """Four weeks arrive one after the other; groups above 60 rows are split."""
    base = scratch_path(spark, "counts")
    events = spark.read.parquet(f"{folder}/events.parquet")
    week = F.floor(F.dayofmonth("ts") / 8)
    for arriving in range(4):
        events.where(week == arriving).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        log_repetitions(stream, ["user_id"], ["event_type"], ["ts", "event_id"], f"{base}/out", f"{base}/checkpoint", 60)
    rows = spark.read.parquet(f"{base}/out/rows")
    return rows.select("event_id", "rep_count", (F.col("rep_count") >= 1).alias("rep_count_ge1"), (F.col("rep_count") >= 2).alias("rep_count_ge2"))


def arriving_late(spark, folder, base, every, drain):
    """The events week by week, a stream run for each; of every ``every`` one comes a week too late."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    week = F.least(F.lit(3), F.floor(F.dayofmonth("ts") / 8) + (F.col("event_id") % every == 0).cast("int"))
    for arriving in range(4):
        events.where(week == arriving).write.mode("append").parquet(f"{base}/in")
        drain(spark.readStream.schema(events.schema).parquet(f"{base}/in"))


@query("stream_repetitions_reordered", REPETITION)
def stream_repetitions_reordered(spark, folder):
    """Rows that come a week late get the counts that they would have had in time."""
    base = scratch_path(spark, "reorder")
    ordered = OrderedRepetitions(["user_id"], ["event_type"], "ts", ["event_id"], 31 * 86_400, f"{base}/out", 60)
    arriving_late(spark, folder, base, 20, lambda stream: ordered.drain(stream, f"{base}/checkpoint"))
    ordered.finish(spark)
    rows = spark.read.parquet(f"{base}/out/rows")
    return rows.select("event_id", "rep_count", (F.col("rep_count") >= 1).alias("rep_count_ge1"), (F.col("rep_count") >= 2).alias("rep_count_ge2"))


@query("stream_late_rows", """
WITH e AS (SELECT *, least(3, CAST(floor(day(ts) / 8) AS INT) + CAST(event_id % 7 = 0 AS INT)) AS batch, time_bucket(INTERVAL '1 day', ts) AS s FROM events),
m AS (SELECT batch, max(ts) AS latest FROM e GROUP BY batch),
p AS (SELECT b.batch, max(a.latest) - INTERVAL '2 days' AS passed FROM m b LEFT JOIN m a ON a.batch < b.batch GROUP BY b.batch)
SELECT epoch_us(s) AS window_start, event_type,
  CAST(count(*) FILTER (NOT coalesce(s + INTERVAL '1 day' <= passed, false)) AS BIGINT) AS rows,
  CAST(count(*) FILTER (coalesce(s + INTERVAL '1 day' <= passed, false)) AS BIGINT) AS late_rows,
  s + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '2 days' AS closed
FROM e JOIN p USING (batch) GROUP BY ALL""")
def stream_late_rows(spark, folder):
    """Daily counts of rows in time, and of those that came when their day had closed."""
    base = scratch_path(spark, "late")
    found = []
    arriving_late(
        spark, folder, base, 7,
        lambda stream: found.append(late_throughput(stream, f"{base}/out", f"{base}/checkpoint", "ts", ["event_type"], "1 day", 2 * 86_400)),
    )
    return found[-1].withColumn("window_start", F.unix_micros("window_start"))


@query("stream_metric_log", ROLLING)
def stream_metric_log(spark, folder):
    base = scratch_path(spark, "metrics")
    log_metrics(stream_table(spark, folder, "events"), f"{base}/rows", f"{base}/checkpoint")
    means = rolling_mean(spark.read.parquet(f"{base}/rows"), ["event_type"], ["ts", "event_id"], "value", 100)
    return means.select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"))


@query("stream_shards", f"""
WITH r AS (SELECT right(sha1('[Event "' || upper(role[1]) || lower(role[2:]) || '"]' || chr(10) || '[Site "first"]' || chr(10)
  || '[Site "turn ' || turn || '"]' || chr(10) || '[Round "' || conv_id || '"]' || chr(10)
  || '[Result "' || CASE WHEN turn % 2 = 0 THEN '1-0' ELSE '0-1' END || '"]' || chr(10) || chr(10)
  || regexp_replace('1. e4 {{' || regexp_replace(text, '[{{}}\\[\\]\\r\\n]+', ' ', 'g')
  || '}} e5 2. Nf3 (2. f4 {{so (far}} exf4 (2... d5)) 2... Nc6 $2 '
  || CASE WHEN turn % 2 = 0 THEN '1-0' ELSE '0-1' END, '[ \\t]+', ' ', 'g') || chr(10)), 2) AS suffix FROM conversations)
SELECT CASE WHEN suffix IN ({literals(chosen_suffixes(0.2, 42, 2))}) THEN 'test' ELSE 'train' END AS split, 'lc0' AS source, count(*) AS records
FROM r GROUP BY ALL""")
def stream_shards_query(spark, folder):
    base = scratch_path(spark, "backlog")
    rendered(spark, folder).select("value").write.text(f"{base}/in")
    stream_shards(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", 0.2, endings=WRITTEN)
    return spark.read.parquet(f"{base}/out").groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"))
