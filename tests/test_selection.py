"""First rows of large groups, samples by place, and paths."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import graph
from corpusmill.operators.graph import shortest_paths
from corpusmill.operators.sampling import sample_files
from corpusmill.operators.sequence import first_per_group
from corpusmill.operators.split import held_out
from corpusmill.session import materialize

R = random.Random(8)


def test_first_rows_of_a_hot_group(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 3).otherwise(F.lit(9)).alias("k"), (F.col("id") * 7919 % 60_000).alias("v"), "id")
    got = first_per_group(df, ["k"], ["v"], 5000)
    rows = got.collect()
    want = sorted(r.v for r in df.where("k = 9").collect())[:5000]
    assert sorted(r.v for r in rows if r.k == 9) == want and len(rows) == 5000 + df.where("k != 9").count()
    assert got.columns == df.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("__heat") > 0


def test_ties_and_repeated_rows(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), F.lit(5).alias("v"), (F.col("id") % 1500).alias("x"))
    for n in (10, 2000, 4000):
        got = first_per_group(df, ["k"], ["v"], n)
        assert got.count() == min(n, 3000)
    assert held_out(df.withColumn("path", F.col("x").cast("string")), 1200, ["k"], 3, "path").count() == 1200
    assert first_per_group(df.where("false"), ["k"], ["v"], 2000).isEmpty()


def test_samples_follow_the_weights(spark, tmp_path):
    path = str(tmp_path / "t")
    for name, n in (("a", 900), ("b", 90), ("c", 10)):
        spark.range(n).select("id", F.lit(name).alias("name")).coalesce(1).write.parquet(f"{path}/part={name}")
    spark.range(0).select("id", F.lit("d").alias("name")).coalesce(1).write.parquet(f"{path}/part=d")
    for mode, want in (("file", (1 / 3, 1 / 3, 1 / 3)), ("uniform", (0.9, 0.09, 0.01))):
        rows = sample_files(spark, path, 3000, 4, mode).collect()
        assert sorted(r.draw_id for r in rows) == list(range(3000)) and all(r.part == r.name for r in rows)
        for name, share in zip("abc", want):
            assert abs(sum(r.name == name for r in rows) / 3000 - share) < 0.04
        again = sample_files(spark, path, 3000, 4, mode, ["id"]).collect()
        assert {r.draw_id: r.id for r in rows} == {r.draw_id: r.id for r in again}
    with pytest.raises(ValueError):
        sample_files(spark, f"{path}/part=d", 5, 1)


def test_paths_equal_a_plain_search(spark):
    edges = [(R.randrange(60), R.randrange(60), R.choice([0.0, 0.5, 1.0, 7.0])) for _ in range(200)]
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    want = {}
    for s in (0, 1, 2, 99):
        done, heap = {}, [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in done:
                done[v] = d
                for b, w in near.get(v, []):
                    heapq.heappush(heap, (d + w, b))
        want |= {(s, v): d for v, d in done.items()}
    table = spark.createDataFrame(edges, "src long, dst long, w double")
    found = shortest_paths(table, spark.createDataFrame([(0,), (1,), (2,), (99,), (1,)], "node long")).collect()
    assert {(r.source, r.node): r.dist for r in found} == want and len(found) == len(want)
    assert spark.sql("SHOW TABLES").where("tableName LIKE 'corpusmill%'").isEmpty()


def test_sources_share_the_rows_of_a_round(spark, monkeypatch):
    written = []

    def counted(df, name):
        out = materialize(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    # 40 sources on a ring with short cuts: one row per node for up to 32 of them, not one for each
    ring = [(v, (v + 1) % 40, 1.0) for v in range(40)] + [(v, (v + 7) % 40, 1.5) for v in range(40)]
    edges = spark.createDataFrame(ring, "src int, dst long, w double")
    found = shortest_paths(edges, spark.range(40).select(F.col("id").cast("int").alias("node")).coalesce(1))
    assert dict(found.dtypes) == {"source": "int", "node": "bigint", "dist": "double"}
    want = {k: min(1.5 * a + (k - 7 * a) % 40 for a in range(8)) for k in range(40)}
    assert {(r.source, r.node): r.dist for r in found.collect()} == {(s, (s + k) % 40): want[k] for s in range(40) for k in range(40)}
    rows = [n for name, n in written if name == "paths"]
    assert max(rows) <= 2 * 40


def test_paths_without_weights_sources_or_nodes(spark):
    edges = spark.createDataFrame([(1, 2, None), (2, 3, 1.0), (3, 2, None), (1, 4, 2.0), (4, None, 1.0), (2, 4, 1.0)], "src int, dst int, w double")
    found = shortest_paths(edges, spark.createDataFrame([(1,), (None,)], "node int")).collect()
    # a missing weight reaches its node and what follows, without a distance
    want = {(1, 1, 0.0), (1, 2, None), (1, 3, None), (1, 4, 2.0), (1, None, 3.0), (None, None, 0.0)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert shortest_paths(edges, spark.createDataFrame([], "node int")).isEmpty()
