"""Chunk files: scanning, counting and telling what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .footers import lacking, read_footers

MANIFEST = ["path", "modified", "bytes", "rows"]



def scan_chunks(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame | None, DataFrame]:
    """(rows with only ``columns`` of all usable files, the other files: ``path, reason``).

    Columns are checked file by file, from footers read on the executors. A file is set aside if it
    lacks a column, holds one with another type than most files do, or can't be read. Without a usable file there are no rows.
    """
    columns, paths = list(columns), list(paths)
    footers = materialize(lacking(read_footers(list_chunks(spark, paths)), columns), "footers")
    whole = F.coalesce(F.size("missing") == 0, F.lit(False))
    kinds = F.transform(F.array(*map(F.lit, columns)), lambda c: F.element_at(F.map_from_arrays("names", "types"), c))
    footers = footers.withColumn("kinds", F.when(whole, kinds))
    # one row to the driver: the commonest types and a file that has them
    usual = footers.where(whole).groupBy("kinds").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).orderBy(F.desc("n"), "path").first()
    reason = F.when(F.col("problem").isNotNull(), F.col("problem")).when(~whole, F.concat(F.lit("lacks "), F.array_join("missing", ", ")))
    if usual is None:
        return None, footers.select("path", reason.alias("reason"))
    other = F.col("kinds") != F.array(*map(F.lit, usual["kinds"]))
    reason = reason.when(other, F.concat(F.lit("holds "), F.array_join("kinds", ", ")))
    footers = materialize(footers.withColumn("reason", reason), "footers")
    skipped = footers.where("reason IS NOT NULL").select("path", "reason")
    schema = spark.read.parquet(usual["path"]).select(*columns).schema
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if not footers.where((F.col("reason") != "") & (F.col("problem").isNotNull() | F.coalesce(other, F.lit(False)))).isEmpty():
        # files that Spark can't read as the others are left out by name; its own file index holds these paths as well
        usable = [r.path for r in footers.where("reason IS NULL").select("path").toLocalIterator()]
        return reader.parquet(*usable).select(*columns), skipped
    rows = reader.parquet(*paths)
    if skipped.isEmpty():
        return rows.select(*columns), skipped
    own = rows.select(*columns, F.col("_metadata.file_path").alias("__path"))
    return own.join(skipped.select(F.col("path").alias("__path")), "__path", "left_anti").select(*columns), skipped


def file_manifest(df: DataFrame) -> DataFrame:
    """Rows per file of a scan: ``path, modified, bytes, rows``."""
    return df.groupBy(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("bytes"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def diff_manifest(old: DataFrame, new: DataFrame, path: str = "path", stamp: str = "modified") -> DataFrame:
    """Every path of either listing with ``status`` added, removed, changed or same."""
    left = old.select(F.col(path).alias("path"), F.col(stamp).alias("old_stamp"))
    right = new.select(F.col(path).alias("path"), F.col(stamp).alias("new_stamp"))
    status = (
        F.when(F.col("old_stamp").isNull(), "added")
        .when(F.col("new_stamp").isNull(), "removed")
        .when(F.col("old_stamp") == F.col("new_stamp"), "same")
        .otherwise("changed")
    )
    return left.join(right, "path", "full_outer").withColumn("status", status)


def same_paths(old: DataFrame, new: DataFrame, path: str = "path") -> bool:
    """Whether both listings name the same files."""
    a, b = old.select(path), new.select(path)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def list_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("modificationTime").alias("modified"),
            F.col("length").alias("bytes"),
        )
    )


def refresh_manifest(spark: SparkSession, path: str, cached: DataFrame | None) -> DataFrame:
    """A manifest of ``path``: ``path, modified, bytes, rows``, written to the shared folder.

    Rows of new and changed files come from their footers, read on the executors; those of the others from the
    cached manifest. Both are found by joins, whatever their number. ``rows`` is null for a file that can't be read.
    """
    listing = list_chunks(spark, path)
    if cached is None:
        return materialize(read_footers(listing).select(*MANIFEST), "manifest")
    changes = materialize(diff_manifest(cached, listing), "changes")
    stale = listing.join(changes.where("status IN ('added', 'changed')").select("path"), "path", "left_semi")
    kept = cached.join(changes.where("status = 'same'").select("path"), "path", "left_semi").select(*MANIFEST)
    return materialize(kept.unionByName(read_footers(stale).select(*MANIFEST)), "manifest")
