"""Jobs account for every record they read."""

from __future__ import annotations

import gzip
import io
import tarfile

from games import LC0, LICHESS, rated
from pyspark.sql import functions as F

from corpusmill.plans.encode import encode_corpus
from corpusmill.plans.shard import corpus_records, judged, shard_corpus
from corpusmill.sources.records import label_split, scan_records
from corpusmill.streaming.shards import stream_shards

BAD = rated(moves="1. e4 (1. d4 *")


def fill(folder) -> None:
    (folder / "deep er").mkdir(parents=True)
    (folder / "lichess_a.pgn").write_bytes((LICHESS + "\n" + BAD + "\n" + rated(white="10")).replace("\n", "\r\n").encode())
    (folder / "deep er" / "lc0_b.pgn").write_text(LC0)
    many = gzip.compress("\n".join(rated(moves=f"{{{i}}} 1. e4 e5 1-0") for i in range(500)).encode())
    (folder / "lichess_half.pgn.gz").write_bytes(many[: len(many) // 2])
    with tarfile.open(folder / "lichess.tar.gz", "w:gz") as tar:
        data = LICHESS.encode()
        entry = tarfile.TarInfo("x.pgn")
        entry.size = len(data)
        tar.addfile(entry, io.BytesIO(data))
    (folder / "torn.tar.gz").write_bytes(b"garbage")


def test_shard_totals_agree(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    fill(raw)
    totals = shard_corpus(spark, str(raw), out, fraction=0.4, range_bytes=300).collect()
    assert all(r.agrees for r in totals)
    (grand,) = [r for r in totals if r.level == 3]
    assert grand.read == grand.written + grand.filtered + grand.quarantined and grand.rows == grand.written
    assert grand.filtered == 1 and grand.quarantined == 3 and grand.written > 100
    bad = spark.read.parquet(f"{out}/_quarantine").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad) == ["lichess_a.pgn", "lichess_half.pgn.gz", "torn.tar.gz"]
    assert sum(r.rows for r in totals if r.level == 0) == grand.rows == scan_records(spark, out, endings=(".txt",)).count()


def test_input_is_read_in_one_pass(spark, tmp_path):
    raw = tmp_path / "raw"
    fill(raw)
    told = judged(corpus_records(spark, str(raw)), 0.4)
    plan = told._jdf.queryExecution().executedPlan().toString()
    # plain files, packed files, archives, and plain archives' list and members: none of them twice
    assert plan.count("MapInPandas") <= 5


def test_stream_totals_agree(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    fill(raw)
    for _ in range(2):
        stream_shards(spark, str(raw), out, str(tmp_path / "checkpoint"), 0.4, files_per_batch=1)
    sums = [F.sum(c).alias(c) for c in ("read", "written", "filtered", "quarantined")]
    totals = spark.read.parquet(f"{out}/_totals").agg(*sums).first()
    assert totals.read == totals.written + totals.filtered + totals.quarantined and totals.written > 100
    assert spark.read.parquet(out).count() == totals.written
    assert spark.read.parquet(f"{out}/_quarantine").count() == totals.quarantined == 2


def test_encode_counts_and_resumes(spark, tmp_path):
    (tmp_path / "train").mkdir()
    text = "\n".join([LICHESS, BAD, rated(white="10"), rated(moves="1. e4 Ke2 1-0"), rated(result="*", moves="1. e4 *")])
    (tmp_path / "train" / "lichess.pgn").write_text(text)
    records = label_split(scan_records(spark, str(tmp_path / "train"))).withColumn("source", F.lit("lichess"))
    out = str(tmp_path / "out")
    row = encode_corpus(records, out, size=8, verify=True, resume_from=f"{out}/steps").first().asDict()
    assert row["games_read"] == 6 and row["games_encoded"] == 2 and row["games_unplayable"] == 1
    assert (row["games_filtered"], row["games_quarantined"]) == (2, 1)
    # the tables of the first run are taken as they are, so no record is needed
    again = encode_corpus(records.where("false"), f"{out}2", size=8, resume_from=f"{out}/steps").first().asDict()
    assert {k: v for k, v in again.items()} == row
