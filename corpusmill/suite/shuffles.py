"""Queries on global order, exact chunks, epochs and written files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.index import hash_ranked, with_global_index
from ..operators.integrity import assert_same
from ..operators.sampling import epochs, even_parts, file_order, shard_index
from ..operators.split import hash_split
from ..session import scratch_path
from ..sources.sinks import chunk_name, reshuffle, resume, stage, verify_write, with_chunks, write_chunks, write_shards
from .profiles import SPLIT, split_documents
from .registry import query, table


@query("global_chunks", """
WITH o AS (SELECT event_id, row_number() OVER (ORDER BY md5('2024|' || event_id)) - 1 AS row_index FROM events)
SELECT event_id, CAST(row_index AS BIGINT) AS row_index, CAST(row_index // 1000 AS BIGINT) AS chunk_id FROM o""")
def global_chunks(spark, folder):
    return with_chunks(table(spark, folder, "events"), 1000, ["event_id"], 2024, by=()).select("event_id", "row_index", "chunk_id")


@query("group_chunks", """
WITH o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('1|' || event_id)) - 1 AS i FROM events)
SELECT event_type, CAST(i // 128 AS BIGINT) AS chunk_id, printf('%s_%07d', event_type, i // 128) AS chunk_name,
       count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS id_sum FROM o GROUP BY ALL""")
def group_chunks(spark, folder):
    chunked = with_chunks(table(spark, folder, "events"), 128, ["event_id"], 1, ["event_type"])
    named = chunked.withColumn("chunk_name", chunk_name("event_type", "chunk_id"))
    return named.groupBy("event_type", "chunk_id", "chunk_name").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("id_sum"))


@query("ordered_chunks", """
WITH o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_id, CAST(i AS BIGINT) AS row_index, CAST(i // 100 AS BIGINT) AS chunk_id FROM o""")
def ordered_chunks(spark, folder):
    """Chunking with the shuffle switched off keeps the given order."""
    chunked = with_chunks(table(spark, folder, "events"), 100, ["ts", "event_id"], 0, ["event_type"], shuffle=False)
    return chunked.select("event_id", "row_index", "chunk_id")


@query("global_index", """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS row_index FROM orders""")
def global_index(spark, folder):
    return with_global_index(table(spark, folder, "orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_index")


@query("chunk_files", """
WITH o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('2024|' || event_id)) - 1 AS i FROM events)
SELECT event_type AS source, CAST(i // 300 AS BIGINT) AS chunk_id, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS id_sum, CAST(1 AS BIGINT) AS files
FROM o GROUP BY ALL""")
def chunk_files(spark, folder):
    """Every written file is exactly one chunk."""
    path = scratch_path(spark, "chunks")
    events = table(spark, folder, "events").withColumnRenamed("event_type", "source")
    write_chunks(events, path, 300, ["event_id"], 2024, ["source"])
    written = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    per_file = written.groupBy("source", "chunk_id", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))
    return per_file.groupBy("source", "chunk_id").agg(
        F.sum("n").alias("rows"), F.sum("s").alias("id_sum"), F.count(F.lit(1)).alias("files")
    )


@query("reshuffled_chunks", f"""
WITH d AS (SELECT {SPLIT} AS split, CASE WHEN lang = 'en' THEN 'lichess' ELSE 'lc0' END AS source FROM documents),
c AS (SELECT split, source, count(*) AS n FROM d GROUP BY ALL)
SELECT {", ".join(f"coalesce(sum(n) FILTER (split = '{b}' AND source = '{a}'), 0)::BIGINT AS total_{a}_{b}_positions, coalesce(sum((n + 49) // 50) FILTER (split = '{b}' AND source = '{a}'), 0)::BIGINT AS {a}_{b}_chunks" for b in ("train", "test") for a in ("lichess", "lc0"))}
FROM c""")
def reshuffled_chunks(spark, folder):
    docs = split_documents(spark, folder).select(
        "doc_id", "n_chars", "split", F.when(F.col("lang") == "en", "lichess").otherwise("lc0").alias("source")
    )
    first, second = scratch_path(spark, "first"), scratch_path(spark, "second")
    write_chunks(docs, first, 50, ["doc_id"], 1)
    return reshuffle(spark, first, second, 50, ["doc_id"], 2).drop("chunk_size", "seed", "last_operation_type")


@query("shard_files", f"""
WITH d AS (SELECT {SPLIT} AS split, source, n_chars FROM documents)
SELECT split, source, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars, true AS within FROM d GROUP BY ALL""")
def shard_files(spark, folder):
    path = scratch_path(spark, "shards")
    write_shards(split_documents(spark, folder), path, 20, key="doc_id", fmt="parquet")
    written = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    per_file = written.groupBy("split", "source", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    return per_file.groupBy("split", "source").agg(
        F.sum("n").alias("rows"), F.sum("c").alias("chars"), (F.max("n") <= 20).alias("within")
    )


@query("staged_table", "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
def staged_table(spark, folder):
    path = scratch_path(spark, "staged")
    labels = table(spark, folder, "labels")
    stage(labels, path)
    verify_write(labels, path)
    rows = resume(spark, path)
    return rows.select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))


@query("even_parts", """
SELECT event_id, CAST(ntile(7) OVER (ORDER BY md5('4|' || event_id)) - 1 AS BIGINT) AS part FROM events""")
def even_parts_query(spark, folder):
    events = table(spark, folder, "events")
    numbered = hash_ranked(events, ["event_id"], 4)
    return even_parts(numbered, "row_index", 7, events.count()).select("event_id", "part")


@query("epochs", """
SELECT p_partkey, CAST(epoch AS BIGINT) AS epoch,
       CAST(row_number() OVER (PARTITION BY epoch ORDER BY md5('6|' || epoch || '|' || p_partkey)) - 1 AS BIGINT) AS position
FROM part, (SELECT unnest([0, 1, 2]) AS epoch)""")
def epochs_query(spark, folder):
    ordered = epochs(table(spark, folder, "part"), 3, 6, "p_partkey")
    return ordered.select("p_partkey", F.col("epoch").cast("bigint").alias("epoch"), "position")


@query("round_robin", """
WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('8|' || p_partkey)) - 1 AS i FROM part)
SELECT p_partkey, CAST(i AS BIGINT) AS file_ordinal, CAST(i % 5 AS BIGINT) AS shard_index FROM o""")
def round_robin(spark, folder):
    ordered = shard_index(file_order(table(spark, folder, "part"), 8, "p_partkey"), "file_ordinal", 5)
    return ordered.select("p_partkey", "file_ordinal", "shard_index")


@query("set_operations", f"""
WITH d AS (SELECT doc_id, {SPLIT} AS split FROM documents)
SELECT split, count(*) AS rows, count(DISTINCT doc_id) AS documents, true AS unchanged FROM d GROUP BY ALL""")
def set_operations(spark, folder):
    """Both sides put together again by name are the whole table."""
    docs = table(spark, folder, "documents")
    split = hash_split(docs, "text", 0.1, 42, 2)
    test, train = (split.where(F.col("split") == side) for side in ("test", "train"))
    whole = test.unionByName(train.select(*reversed(split.columns)))
    assert_same(docs, whole.drop("split"))
    return whole.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents"), F.lit(True).alias("unchanged")
    )
