"""Streams fed in steps."""

from games import LC0, LICHESS
from pyspark.sql import functions as F

from corpusmill.streaming.metric_log import log_metrics
from corpusmill.streaming.repetition import stream_repetitions
from corpusmill.streaming.run import PROVIDER, ROCKSDB, drain
from corpusmill.streaming.shards import stream_shards


def test_backlog_is_taken_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lichess_1.pgn").write_text(LICHESS)
    stream_shards(spark, source, out, checkpoint)
    assert spark.read.parquet(out).count() == 2
    (tmp_path / "in" / "lc0_1.pgn").write_text(LC0)
    for _ in range(2):
        stream_shards(spark, source, out, checkpoint)
        rows = spark.read.parquet(out).groupBy("source").count().collect()
        assert {r.source: r["count"] for r in rows} == {"lichess": 2, "lc0": 2}


def test_counts_go_on_across_batches(spark, tmp_path):
    schema = "game int, state string, ply int"
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        for step in range(3):
            rows = [(g, "xyz"[p % 3], p) for g in (1, 2) for p in range(step * 6, step * 6 + 6)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            counted = stream_repetitions(stream, ["game"], ["state"], ["ply"])
            drain(counted, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set(PROVIDER, before)
    rows = spark.read.schema(f"{schema}, rep_count long").parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 36 and all(r.rep_count == r.ply // 3 for r in rows)


def test_groups_share_calls_and_state_keys(spark, tmp_path):
    # a call of Python per group took most of the time
    schema = "game long, state string, weight double, at timestamp, ply int"
    rows = [(g or None, s, w, f"2024-01-01 00:00:00.{u:06d}", p) for g in range(60) for s in ("a,b", "a", None) for w, u in ((0.0, 1), (-0.0, 1), (1.0, 2)) for p in range(2)]
    typed = spark.createDataFrame(rows, "game long, state string, weight double, at string, ply int").withColumn("at", F.col("at").cast("timestamp"))
    typed.coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        counted = stream_repetitions(stream, ["game"], ["state", "weight", "at"], ["ply"], buckets=8)
        drain(counted, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        kept = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "checkpoint"))
        assert kept.select("key").distinct().count() <= 8
    finally:
        spark.conf.set(PROVIDER, before)
    out = spark.read.schema(f"{schema}, rep_count long").parquet(str(tmp_path / "out"))
    # 0.0 and -0.0 are one group of four rows, 1.0 has two
    got = {(r.game, r.state, r.light): sorted(r.counts) for r in out.groupBy("game", "state", (F.col("weight") < 0.5).alias("light")).agg(F.collect_list("rep_count").alias("counts")).collect()}
    assert got == {(g or None, s, light): list(range(4 if light else 2)) for g in range(60) for s in ("a,b", "a", None) for light in (True, False)}


def test_metric_batches_replace_themselves(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # a lost checkpoint replays batch 0
        log_metrics(stream, str(tmp_path / "log"), str(tmp_path / checkpoint))
    assert spark.read.parquet(str(tmp_path / "log")).agg(F.count("id")).first()[0] == 10
