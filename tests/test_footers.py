"""Chunk files judged and counted by their footers."""

from __future__ import annotations

import shutil

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpusmill.sources.chunks import list_chunks, refresh_manifest, same_paths, scan_chunks
from corpusmill.sources.footers import read_footers


def put(path, **columns) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_footers(spark, tmp_path):
    put(tmp_path / "a b" / "x.parquet", i=[1, 2, 3], s=["a", "b", None])
    put(tmp_path / "y.parquet", i=pa.array([], pa.int64()))
    (tmp_path / "torn.parquet").write_bytes(b"PAR1 nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_footers(list_chunks(spark, str(tmp_path))).collect()}
    assert (rows["x.parquet"].rows, rows["x.parquet"].names, rows["x.parquet"].types) == (3, ["i", "s"], ["int64", "string"])
    assert rows["y.parquet"].rows == 0 and rows["y.parquet"].problem is None
    assert rows["torn.parquet"].rows is None and rows["torn.parquet"].problem
    listed = {r.path: r.modified for r in list_chunks(spark, str(tmp_path)).collect()}
    assert all(listed[r.path] == r.modified for r in rows.values())


def test_only_bad_files_are_set_aside(spark, tmp_path):
    for k in range(6):
        put(tmp_path / "one" / f"{k}.parquet", i=[k], v=[float(k)])
    put(tmp_path / "one" / "less.parquet", i=[100])
    put(tmp_path / "two" / "more.parquet", v=[7.0], i=[7], w=["extra"])
    paths = [str(tmp_path / "one"), str(tmp_path / "two")]
    rows, skipped = scan_chunks(spark, paths, ["i", "v"])
    assert sorted(map(tuple, rows.collect())) == [(k, float(k)) for k in (0, 1, 2, 3, 4, 5, 7)]
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in skipped.collect()] == [("less.parquet", "lacks v")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<i:bigint,v:double>" in plan
    put(tmp_path / "one" / "text.parquet", i=["8"], v=[8.0])
    (tmp_path / "one" / "torn.parquet").write_bytes(b"PAR1")
    rows, skipped = scan_chunks(spark, paths, ["i", "v"])
    assert rows.count() == 7 and skipped.count() == 3
    none, skipped = scan_chunks(spark, paths, ["q"])
    assert none is None and skipped.count() == 10


def test_recount_of_many_changed_files(spark, tmp_path):
    folder = tmp_path / "many"
    put(folder / "0.parquet", i=[1, 2])
    put(folder / "old.parquet", i=[1, 2, 3])
    first = refresh_manifest(spark, str(folder), None)
    assert sum(r.rows for r in first.collect()) == 5
    # a count that no file has: it must be taken from the cached manifest
    cached = first.withColumn("rows", F.when(F.col("path").endswith("old.parquet"), 1000).otherwise(F.col("rows")).cast("bigint"))
    for k in range(1, 20_002):
        shutil.copyfile(folder / "0.parquet", folder / f"{k}.parquet")
    grown = refresh_manifest(spark, str(folder), cached)
    assert grown.agg(F.sum("rows"), F.count("rows")).first() == (1000 + 2 + 2 * 20_001, 20_003)
    assert same_paths(grown, list_chunks(spark, str(folder)))
    (folder / "7.parquet").unlink()
    assert refresh_manifest(spark, str(folder), grown).count() == 20_002
