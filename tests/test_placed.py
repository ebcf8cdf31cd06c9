"""Chunks placed with one exchange."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.placed import RepeatedKeys, placed_chunks
from corpusmill.sources.sinks import with_chunks, write_chunks


def rows_of(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 41).cast("string"))))
    return df.withColumn("g", F.when(F.col("g") != "g7", F.col("g")))  # and a null group


@pytest.mark.parametrize("size, partitions", [(100, 8), (7, 33), (10_000, 8), (1, 300)])
def test_order_and_places(spark, size, partitions):
    df = rows_of(spark)
    got = placed_chunks(df, size, ["id"], 5, ["g"], partitions).withColumn("part", F.spark_partition_id()).collect()
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append((hashlib.md5(f"5|{r.id}".encode()).hexdigest(), r.id))
    want = {(g, i): k for g, rows in groups.items() for k, (_, i) in enumerate(sorted(rows))}
    assert {(r.g, r.id): r.row_index for r in got} == want and len(got) == 5000
    assert all(r.chunk_id == r.row_index // size for r in got)
    homes: dict = {}
    for r in got:
        homes.setdefault((r.g, r.chunk_id), set()).add(r.part)
    assert all(len(h) == 1 for h in homes.values())


def test_one_exchange(spark, tmp_path):
    rows_of(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = placed_chunks(df, 100, ["id"], 5, ["g"])._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert len(moves) == 1, plan


def test_repeated_keys_go_the_other_way(spark, tmp_path):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id", F.lit("a").alias("g"))
    with pytest.raises(RepeatedKeys):
        placed_chunks(df, 10, ["k"], 1, ["g"], 8)
    write_chunks(df, str(tmp_path / "c"), 10, ["k"], 1, ["g"])
    written = spark.read.parquet(str(tmp_path / "c")).withColumn("file", F.col("_metadata.file_name"))
    assert written.groupBy("file").agg(F.count_distinct("chunk_id").alias("n"), F.count(F.lit(1)).alias("m")).where("n != 1 OR m != 10").isEmpty()


def test_same_numbers_as_the_plain_way(spark):
    df = rows_of(spark)
    a = placed_chunks(df, 64, ["id"], 9, ["g"], 16)
    b = with_chunks(df, 64, ["id"], 9, ["g"])
    assert a.exceptAll(b.select(a.columns)).isEmpty() and a.count() == b.count()
    assert placed_chunks(df.where("false"), 64, ["id"], 9, ["g"]).isEmpty()
