"""Queries on files: ranges, damage, totals of a job and columns that are missing."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import sample_files
from ..plans.shard import shard_corpus
from ..session import scratch_path, ship_package
from ..sources.archives import _open_output
from ..sources.chunks import refresh_manifest, same_paths, scan_chunks
from ..sources.ranges import read_records
from ..sources.sinks import manifest_row, write_manifest
from .records import SCAN_SQL, parsed_back, rendered
from .registry import query, table

PER_FILE = 50
STORED = 23  # bytes that a stored gzip member adds to less than 64 KB of text
LEFT = 8  # bytes of text that the cut member keeps


def write_files(rows: DataFrame, target: str, order: list[str], pack=None) -> None:
    """Files named by ``file`` with the ``value`` of their rows in order; ``pack`` may change each value's bytes."""
    spark = rows.sparkSession
    ship_package(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    # with its scheme, so that all executors write to the shared file system
    base = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()

    def write(batches):
        import pandas as pd

        name, out, done = None, None, 0
        for batch in batches:
            for row in batch.itertuples():
                if row.file != name:
                    if out is not None:
                        out.close()
                    name, out, done = row.file, _open_output(f"{base}/{row.file}"), done + 1
                data = row.value.encode()
                out.write(pack(data, row) if pack else data)
        if out is not None:
            out.close()
        yield pd.DataFrame({"n": [done]})

    placed = rows.repartition("file").sortWithinPartitions("file", *order)
    placed.mapInPandas(write, "n bigint").write.parquet(scratch_path(spark, "written"))


@query("ranged_records", SCAN_SQL)
def ranged_records(spark, folder):
    """Files with the other line ends, each read by several tasks."""
    target = scratch_path(spark, "ranged")
    windows = rendered(spark, folder).withColumn("value", F.replace(F.concat("value", F.lit("\n")), F.lit("\n"), F.lit("\r\n")))
    number = F.floor(F.col("conv_id") / PER_FILE).cast("string")
    write_files(windows.withColumn("file", F.concat(F.lit("part-"), number, F.lit(".pgn"))), target, ["conv_id", "turn"])
    return parsed_back(read_records(spark, target, range_bytes=1 << 16))


def cut_member(data: bytes, row) -> bytes:
    """A gzip member that stores its text; the one at the cut has its first bytes only, later ones nothing."""
    if row.place > row.whole + 1:
        return b""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    member = packer.compress(data) + packer.flush()
    return member if row.place <= row.whole else member[: 15 + LEFT]


@query("damaged_files", f"""
WITH r AS (
  SELECT conv_id, turn, conv_id // {PER_FILE} AS file_no, strlen(
    '[Event "' || upper(role[1]) || lower(role[2:]) || '"]' || chr(10) || '[Site "first"]' || chr(10) || '[Site "turn ' || turn || '"]' || chr(10)
    || '[Round "' || conv_id || '"]' || chr(10) || '[Result "1-0"]' || chr(10) || chr(10) || '1. e4 {{'
    || regexp_replace(text, '[{{}}\\[\\]\\r\\n]+', ' ', 'g') || '}} e5 2. Nf3 (2. f4 {{so (far}} exf4 (2... d5)) 2... Nc6 $2 1-0') + 2 + {STORED} AS bytes
  FROM conversations),
p AS (SELECT *, row_number() OVER w AS place, count(*) OVER f // 2 AS whole, sum(bytes) OVER w - bytes AS before FROM r
  WINDOW f AS (PARTITION BY file_no), w AS (PARTITION BY file_no ORDER BY conv_id, turn))
SELECT file_no, conv_id, turn, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS damaged_at, CAST(NULL AS VARCHAR) AS fragment
FROM p WHERE place <= whole
UNION ALL SELECT file_no, NULL, NULL, 'gzip: the file ends inside a member', CAST(before AS BIGINT) + {15 + LEFT}, '[Event "'
FROM p WHERE place = whole + 1
""")
def damaged_files(spark, folder):
    """Gzip files that end inside the member of their middle record: what was read, and what was told about the rest."""
    from pyspark.sql import Window

    target = scratch_path(spark, "damaged")
    file_no = F.floor(F.col("conv_id") / PER_FILE)
    own = Window.partitionBy("file_no")
    rows = rendered(spark, folder).withColumn("value", F.concat("value", F.lit("\n"))).withColumn("file_no", file_no)
    rows = rows.withColumns(
        {
            "file": F.concat(F.lit("f"), F.col("file_no").cast("string"), F.lit(".pgn.gz")),
            "place": F.row_number().over(own.orderBy("conv_id", "turn")),
            "whole": F.floor(F.count(F.lit(1)).over(own) / 2),
        }
    )
    write_files(rows, target, ["conv_id", "turn"], cut_member)
    found = read_records(spark, target)
    good = F.col("damage").isNull()
    tag = lambda name, pattern: F.when(good, F.regexp_extract("text", rf'\[{name} "{pattern}(\d+)"\]', 1).cast("bigint"))
    return found.select(
        F.regexp_extract("file_name", r"^f(\d+)\.", 1).cast("bigint").alias("file_no"),
        tag("Round", "").alias("conv_id"),
        tag("Site", "turn ").alias("turn"),
        F.col("damage").alias("reason"),
        "damaged_at",
        F.when(~good, F.col("text")).alias("fragment"),
    )


@query("job_reconciliation", """
WITH r AS (
  SELECT CASE WHEN conv_id % 2 = 0 THEN 'lichess' ELSE 'lc0' END AS source,
    CASE WHEN turn % 3 = 1 THEN 'quarantined' WHEN conv_id % 2 = 0 AND turn % 3 = 2 THEN 'filtered' ELSE 'written' END AS fate
  FROM conversations),
c AS (
  SELECT 'train' AS split, source, count(*) AS read, count(*) FILTER (fate = 'written') AS written,
    count(*) FILTER (fate = 'filtered') AS filtered, count(*) FILTER (fate = 'quarantined') AS quarantined, 0 AS level
  FROM r GROUP BY source
  UNION ALL SELECT NULL, NULL, count(*), count(*) FILTER (fate = 'written'), count(*) FILTER (fate = 'filtered'),
    count(*) FILTER (fate = 'quarantined'), 3 FROM r)
SELECT split, source, read, written, filtered, quarantined, written AS rows, CAST(level AS BIGINT) AS level, true AS agrees FROM c
""")
def job_reconciliation(spark, folder):
    """The shard job over the turns as games: every third is torn, and some of one source are of too low a rating."""
    target = scratch_path(spark, "raw")
    turns = table(spark, folder, "conversations")
    rating = F.when(F.col("turn") % 3 == 2, "1200").otherwise("2100")
    comment = F.regexp_replace("text", r"[{}\[\]\r\n]+", " ")
    head = ['[Event "Rated Blitz game"]', '[Site "', '"]\n[Termination "Normal"]\n[BlackElo "2000"]\n[WhiteElo "', '"]\n[Result "1-0"]\n\n1. e4 {']
    value = F.concat(
        F.lit(head[0] + "\n" + head[1]), F.concat_ws("/", "conv_id", "turn"), F.lit(head[2]), rating, F.lit(head[3]), comment,
        F.lit("} "), F.when(F.col("turn") % 3 == 1, "(1. d4 ").otherwise("e5 "), F.lit("1-0\n\n"),
    )
    source = F.when(F.col("conv_id") % 2 == 0, "lichess_").otherwise("lc0_")
    name = F.concat(source, F.floor(F.col("conv_id") / PER_FILE).cast("string"), F.lit(".pgn"))
    write_files(turns.select("conv_id", "turn", value.alias("value"), name.alias("file")), target, ["conv_id", "turn"])
    totals = shard_corpus(spark, target, scratch_path(spark, "shards"), range_bytes=20_000)
    return totals.where("level IN (0, 3)")


def bucketed(df: DataFrame, path: str, key: str, only=None) -> None:
    """A folder per remainder of ``key``, with a file in each."""
    rows = df.withColumn("bucket", F.col(key) % 8)
    rows = rows if only is None else rows.where(only)
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


@query("mixed_chunk_scan", """
SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(NULL AS VARCHAR) AS reason FROM labels WHERE doc_id % 8 NOT IN (3, 5)
UNION ALL SELECT NULL, NULL, reason FROM (VALUES (3, 'lacks quality'), (5, 'holds string')) s(b, reason)
WHERE b IN (SELECT doc_id % 8 FROM labels)
""")
def mixed_chunk_scan(spark, folder):
    """A folder in which one file lacks a column and another one holds it as text: all other files are read."""
    path = scratch_path(spark, "mixed")
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    bucketed(labels, path, "doc_id", "bucket NOT IN (3, 5)")
    bucketed(labels.drop("quality"), path, "doc_id", "bucket = 3")
    bucketed(labels.withColumn("quality", F.col("quality").cast("string")), path, "doc_id", "bucket = 5")
    rows, _ = scan_chunks(spark, [path], ["quality", "doc_id"])
    _, skipped = scan_chunks(spark, [path], ["quality"])
    good = rows.select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(skipped.select("reason"), allowMissingColumns=True)


@query("manifest_refresh", """
SELECT o_orderkey % 8 AS bucket, count(*) + count(*) FILTER (o_orderkey % 8 = 2) AS rows,
  CASE WHEN o_orderkey % 8 = 2 THEN 2 ELSE 1 END AS files
FROM orders GROUP BY ALL
""")
def manifest_refresh(spark, folder):
    """A manifest of some files brought up to date after others were added."""
    path = scratch_path(spark, "chunks")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    bucketed(orders, path, "o_orderkey", "bucket < 4")
    first = refresh_manifest(spark, path, None)
    bucketed(orders, path, "o_orderkey", "bucket >= 4")
    bucketed(orders, path, "o_orderkey", "bucket = 2")
    found = refresh_manifest(spark, path, first)
    bucket = F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("bigint").alias("bucket")
    return found.groupBy(bucket).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).cast("int").alias("files"))


FILE_DRAWS = """
WITH r AS (SELECT o_orderkey, o_orderkey % 8 AS b, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) - 1 AS row FROM orders),
f AS (SELECT b, count(*) AS n, row_number() OVER (ORDER BY b) - 1 AS ordinal, sum(count(*)) OVER (ORDER BY b) - count(*) AS first FROM r GROUP BY b),
d AS (SELECT i AS draw_id, ('0x' || substr(md5('9|' || i || '|f'), 1, 15))::BIGINT AS fh, ('0x' || substr(md5('9|' || i || '|r'), 1, 15))::BIGINT AS rh
  FROM range(3000) r(i))
"""


def sampled(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    path = scratch_path(spark, "files")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice").withColumn("bucket", F.col("o_orderkey") % 8)
    orders.repartition("bucket").sortWithinPartitions("bucket", "o_orderkey").write.partitionBy("bucket").parquet(path)
    return sample_files(spark, path, 3000, 9, mode, ["o_orderkey", "bucket"]).withColumn("bucket", F.col("bucket").cast("bigint"))


@query("sampled_files", FILE_DRAWS + """
SELECT draw_id, o_orderkey, b AS bucket FROM d JOIN f ON ordinal = fh % (SELECT count(*) FROM f) JOIN r USING (b) WHERE r.row = rh % n""")
def sampled_files(spark, folder):
    """A file, then a row of it, by its place in the file."""
    return sampled(spark, folder, "file")


@query("sampled_rows", FILE_DRAWS + """
SELECT draw_id, o_orderkey, b AS bucket FROM d JOIN (SELECT *, first + row AS spot FROM f JOIN r USING (b)) ON spot = rh % (SELECT count(*) FROM orders)""")
def sampled_rows(spark, folder):
    """Any row with the same weight, by its place among all files."""
    return sampled(spark, folder, "uniform")


@query("manifest_file", """
WITH o AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'train' END AS split,
  CASE WHEN o_orderpriority < '3' THEN 'lichess' ELSE 'lc0' END AS source, o_orderkey // 64 AS c FROM orders)
SELECT count(*) FILTER (source = 'lichess' AND split = 'train') AS total_lichess_train_positions,
  count(*) FILTER (source = 'lc0' AND split = 'test') AS total_lc0_test_positions,
  count(DISTINCT c) FILTER (source = 'lc0' AND split = 'train') AS lc0_train_chunks, CAST(64 AS BIGINT) AS chunk_size, true AS stamped
FROM o""")
def manifest_file(spark, folder):
    """A manifest written as JSON and read back, with its time of writing."""
    path = scratch_path(spark, "manifest")
    split = F.when(F.col("o_orderstatus") == "F", "test").otherwise("train")
    source = F.when(F.col("o_orderpriority") < "3", "lichess").otherwise("lc0")
    orders = table(spark, folder, "orders")
    chunked = orders.select(split.alias("split"), source.alias("source"), F.floor(F.col("o_orderkey") / 64).alias("chunk_id"))
    write_manifest(manifest_row(chunked, params={"chunk_size": 64}), path)
    row = spark.read.json(path)
    return row.select(
        "total_lichess_train_positions", "total_lc0_test_positions", "lc0_train_chunks", "chunk_size",
        F.to_timestamp("preprocessing_date").between(F.current_timestamp() - F.expr("INTERVAL 1 HOUR"), F.current_timestamp()).alias("stamped"),
    )


@query("same_file_sets", """
SELECT true AS of_itself, count(*) FILTER (p_size > 25) = 0 AS of_the_small, count(*) FILTER (p_partkey % 2 = 0) = count(*) AS of_the_even
FROM part""")
def same_file_sets(spark, folder):
    """Whether two listings name the same files, whatever their times."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size", "p_partkey")
    found = [same_paths(parts, other) for other in (parts.withColumn("p_size", F.lit(0)), parts.where("p_size <= 25"), parts.where("p_partkey % 2 = 0"))]
    names = ("of_itself", "of_the_small", "of_the_even")
    return spark.range(1).select(*[F.lit(same).alias(name) for name, same in zip(names, found)])
