"""Streams whose rows come in the wrong batch."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusmill.streaming.reorder import OrderedRepetitions, counts_before, late_throughput, merged_numbers, write_counts

R = random.Random(4)
SCHEMA = "game int, state string, at timestamp, ply int"


def feed(spark, tmp_path, rows, drain):
    table = spark.createDataFrame(rows, "game int, state string, second long, ply int")
    table = table.withColumn("at", F.timestamp_seconds("second")).select("game", "state", "at", "ply")
    table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return drain(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))


def test_rows_in_the_wrong_batch(spark, tmp_path):
    rows = [(1 + p % 2, "xyz"[p % 3], 10 * p, p) for p in range(90)]
    batches = [[], [], []]
    for p, row in enumerate(rows):  # every fifth comes one batch late
        batches[min(2, p // 30 + (p % 5 == 0))].append(row)
    batches[2] += [(1, "x", 3, 900), (1, "x", None, 901)]  # long passed, and without a time
    out = str(tmp_path / "out")
    ordered = OrderedRepetitions(["game"], ["state"], "at", ["ply"], 400, out, hot_rows=10)
    for batch in batches:
        feed(spark, tmp_path, batch, lambda stream: ordered.drain(stream, str(tmp_path / "checkpoint")))
    waiting = spark.read.parquet(f"{out}/pending/batch=2").count()
    done = spark.read.parquet(f"{out}/rows").count()
    assert waiting > 0 and done + waiting == 90
    ordered.finish(spark)
    got = {r.ply: r.rep_count for r in spark.read.parquet(f"{out}/rows").collect()}
    seen: dict = {}
    for g, s, _, p in rows:
        assert got[p] == seen.get((g, s), 0)
        seen[g, s] = seen.get((g, s), 0) + 1
    late = spark.read.parquet(f"{out}/late").collect()
    assert sorted(r.ply for r in late) == [900, 901] and len(got) == 90
    # a batch that is run again writes the same
    again = spark.read.parquet(str(tmp_path / "in")).where("false")
    ordered.take(again, 3, last=True)
    assert spark.read.parquet(f"{out}/rows").count() == 90


def test_counts_are_merged_in_levels(spark, tmp_path):
    path, want = str(tmp_path), {}
    for n in range(20):
        before = counts_before(spark, path, n) if n < 16 else counts_before(spark, path, n)
        if n in (1, 15, 16, 19):
            got = {r.k: r.s for r in before.groupBy("k").agg(F.sum("n").alias("s")).collect()}
            assert got == want
        write_counts(spark.createDataFrame([(n % 3, 1), (7, 2)], "k int, n long"), path, n, ["k"])
        want[n % 3] = want.get(n % 3, 0) + 1
        want[7] = want.get(7, 0) + 2
    assert merged_numbers(19) == [(0, 16), (0, 17), (0, 18), (1, 0)] and merged_numbers(0) == []
    assert all(sum(16**level for level, _ in merged_numbers(n)) == n for n in range(600))


def test_late_rows_are_counted(spark, tmp_path):
    def drain(stream):
        return late_throughput(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "at", ["game"], "10 seconds", 20)

    feed(spark, tmp_path, [(1, "a", s, s) for s in range(0, 100)], drain)
    found = feed(spark, tmp_path, [(1, "a", 5, 0), (1, "a", 95, 1), (1, "a", 300, 2), (1, "a", None, 3)], drain)
    rows = {None if r.window_start is None else int(r.window_start.timestamp()): (r.rows, r.late_rows, r.closed) for r in found.collect()}
    assert rows[0] == (10, 1, True) and rows[90] == (11, 0, True) and rows[300] == (1, 0, False) and rows[None][:2] == (1, 0)
    assert sum(a + b for a, b, _ in rows.values()) == 104
