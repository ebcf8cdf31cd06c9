"""Inputs that once lost rows or failed."""

from __future__ import annotations

import math

from games import rated
from pyspark.sql import functions as F

from corpusmill.functions.losses import masked_policy_loss
from corpusmill.functions.text import decode, movetext_tokens
from corpusmill.operators.groups import ranked
from corpusmill.operators.profile import plane_usage
from corpusmill.operators.sampling import global_shuffle
from corpusmill.plans.shard import shard_corpus
from corpusmill.sources.records import label_split, scan_records
from corpusmill.streaming.shards import stream_shards


def test_deep_variations(spark):
    deep = "1. e4 " + "(1. d4 " * 12 + ")" * 12 + " e5 2. (a(b)c) Nf3 *"
    df = spark.createDataFrame([(deep,), ("1. e4 (1. d4 *",)], "m string")
    rows = [r[0] for r in df.select(movetext_tokens("m")).collect()]
    assert rows[0] == ["e4", "e5", "Nf3"] and any("(" in t for t in rows[1])


def test_long_runs_of_line_ends(spark, tmp_path):
    record = '[Event "a"]\n\n1. e4 *'
    (tmp_path / "a.pgn").write_text(record + "\n" * 100_000 + record + "\n" * 50_000 + "x\n\n" + record)
    (tmp_path / "b.pgn").write_bytes("\r\n\r\n".join([record.replace("\n", "\r\n")] * 50).encode())
    found = scan_records(spark, str(tmp_path), endings=(".pgn",))
    assert {r["file_name"]: r["count"] for r in found.groupBy("file_name").count().collect()} == {"a.pgn": 3, "b.pgn": 50}


def test_all_squares_of_planes(spark):
    df = spark.range(3).select(F.sequence(F.lit(0), F.lit(73 * 64 - 1)).alias("p"))
    usage = {r["plane"]: r["usage"] for r in plane_usage(df, "p", 73, "full").collect()}
    assert len(usage) == 73 and usage[1] == 3 * sum(range(64, 128))


def test_shuffle_of_tied_keys_ignores_the_layout(spark):
    df = spark.range(400).select((F.col("id") % 7).alias("k"), "id")
    one, four = (global_shuffle(df.repartition(n), ["k"], 3).collect() for n in (1, 4))
    assert one == four


def test_many_hot_keys(spark):
    df = spark.range(44_000).select((F.col("id") % 11_000).alias("k"), "id")
    got = ranked(df, ["k"], ["id"], hot_rows=2)
    assert got.where(F.col("rn") != F.floor(F.col("id") / 11_000) + 1).count() == 0 and got.count() == 44_000


def test_bad_records_are_set_aside(spark, tmp_path):
    raw, out, streamed = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "streamed")
    raw.mkdir()
    (raw / "lichess_a.pgn").write_text(rated() + "\n" + rated(moves="1. e4 (1. d4 *") + "\n" + rated(white="10"))
    (raw / "torn.tar.gz").write_bytes(b"garbage")
    shard_corpus(spark, str(raw), out)
    assert scan_records(spark, out, endings=(".txt",)).count() == 1
    bad = spark.read.parquet(f"{out}/_quarantine").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.text is None) for r in bad) == [("lichess_a.pgn", False), ("torn.tar.gz", True)]
    assert all(r.reason for r in bad)
    stream_shards(spark, str(raw), streamed, str(tmp_path / "checkpoint"))
    assert spark.read.parquet(streamed).count() == 1
    assert spark.read.parquet(f"{streamed}/_quarantine").count() == 1


def test_dropped_bytes_spare_replacement_marks(spark):
    raw = [b"a\xef\xbf\xbdb\xffc", b"\x00a\x00b\xfe\x00", b"\xff", None]
    df = spark.createDataFrame([(x,) for x in raw], "raw binary")
    assert [r[0] for r in df.select(decode("raw", "ignore")).collect()] == ["a�bc", "\0a\0b\0", "", None]


def test_no_legal_list_allows_all(spark):
    df = spark.sql("SELECT array(0D, 1D, 2D) AS x, CAST(NULL AS array<int>) AS legal, 1 AS t")
    loss = df.select(masked_policy_loss("x", "legal", "t")).first()[0]
    assert abs(loss - (math.log(sum(map(math.exp, range(3)))) - 1)) < 1e-12


def test_split_below_the_root(spark):
    df = spark.createDataFrame([("file:/data/train/proj/raw/test/a.pgn",), ("file:/data/train/proj/raw/b.pgn",)], "path string")
    assert [r.split for r in label_split(df, root="/data/train/proj/raw/").collect()] == ["test", None]
