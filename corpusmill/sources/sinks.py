"""Writing shards, chunks, manifests and quarantine tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import ranked
from ..operators.index import hash_ranked
from ..operators.integrity import assert_same
from ..operators.placed import ManyGroups, RepeatedKeys, placed_chunks
from ..operators.sequence import first_per_group
from ..session import path_exists


def write_shards(
    df: DataFrame,
    path: str,
    records_per_shard: int = 5000,
    text: str = "text",
    key: str = "record_id",
    by: Sequence[str] = ("split", "source"),
    fmt: str = "text",
) -> None:
    """Shards of at most ``records_per_shard`` records under ``split=…/source=…``.

    One pass, no counting: records are salted by their id over all shuffle partitions,
    so neither a large source nor repeated texts fill one task. Small neighbours are
    merged by adaptive execution; the last shard of a group in each task may be short.
    """
    by = list(by)
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(*by, F.pmod(F.xxhash64(key), F.lit(salts)))
    columns = [*by, F.col(text).alias("value")] if fmt == "text" else df.columns
    writer = spread.select(*columns).write.partitionBy(*by)
    writer.option("maxRecordsPerFile", records_per_shard).format(fmt).save(path)


def with_chunks(
    df: DataFrame,
    size: int,
    key: Sequence[str],
    seed: int,
    by: Sequence[str] = ("split", "source"),
    shuffle: bool = True,
) -> DataFrame:
    """Adds ``row_index`` and ``chunk_id``, dense from 0 per group; all chunks but the last hold ``size`` rows."""
    if shuffle:
        numbered = hash_ranked(df, key, seed, by)
    else:
        numbered = ranked(df, by, key, "__rn").withColumn("row_index", F.col("__rn") - 1).drop("__rn")
    return numbered.withColumn("chunk_id", F.floor(F.col("row_index") / size).cast("bigint"))


def chunk_name(source, chunk_id):
    return F.format_string("%s_%07d", source, chunk_id)


def write_chunks(
    df: DataFrame,
    path: str,
    size: int = 8192,
    key: Sequence[str] = ("game_id", "ply"),
    seed: int = 2024,
    by: Sequence[str] = ("split", "source"),
    shuffle: bool = True,
) -> None:
    """One zstd Parquet file per chunk under the group's folder, rows in shuffled order.

    A partition holds whole chunks, so cutting files at ``size`` rows cuts at chunk ends. Shuffled rows are moved once;
    unshuffled ones, and those whose keys repeat at a border or whose groups are very many, are numbered first and then
    moved by ranges.
    """
    placed = None
    if shuffle:
        with suppress(RepeatedKeys, ManyGroups):
            placed = placed_chunks(df, size, key, seed, by)
    if placed is None:
        order = [*by, "chunk_id"]
        placed = with_chunks(df, size, key, seed, by, shuffle).repartitionByRange(*order).sortWithinPartitions(*order, "row_index")
    placed.write.partitionBy(*by).option("maxRecordsPerFile", size).option("compression", "zstd").parquet(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate table and continue from it."""
    df.write.mode("overwrite").parquet(path)
    return resume(df.sparkSession, path)


def resume(spark: SparkSession, path: str) -> DataFrame:
    """Continue from a staged table; refuses one that is missing, unfinished or empty."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"no finished staged table at {path}")
    table = spark.read.parquet(path)
    if table.isEmpty():
        raise ValueError(f"the staged table at {path} is empty")
    return table


def verify_write(expected: DataFrame, path: str) -> None:
    """Re-read ``path`` and compare counts and column sums with what was to be written."""
    written = expected.sparkSession.read.parquet(path)
    assert_same(expected, written.select(*[F.col(c).cast(expected.schema[c].dataType).alias(c) for c in expected.columns]))


def manifest_row(
    df: DataFrame,
    splits: Sequence[str] = ("train", "test"),
    sources: Sequence[str] = ("lichess", "lc0"),
    params: Mapping[str, object] | None = None,
) -> DataFrame:
    """One wide row: positions and chunks per source and split (0 when absent) and the parameters."""
    pairs = [(source, split) for split in splits for source in sources]
    cell = F.concat_ws("_", "source", "split")
    wide = _pivot(df, cell, [f"{a}_{b}" for a, b in pairs])
    names = []
    for source, split in pairs:
        name = f"{source}_{split}"
        names.append(F.coalesce(F.col(f"{name}_positions"), F.lit(0)).alias(f"total_{name}_positions"))
    for source, split in pairs:
        name = f"{source}_{split}"
        names.append(F.coalesce(F.col(f"{name}_chunks"), F.lit(0)).alias(f"{name}_chunks"))
    constants = [F.lit(value).alias(name) for name, value in (params or {}).items()]
    return wide.select(*names, *constants)


def _pivot(df: DataFrame, cell, values: Sequence[str]) -> DataFrame:
    return (
        df.select(cell.alias("__cell"), "chunk_id")
        .groupBy()
        .pivot("__cell", list(values))
        .agg(F.count(F.lit(1)).alias("positions"), F.count_distinct("chunk_id").alias("chunks"))
    )


def write_manifest(row: DataFrame, path: str) -> None:
    """The manifest as JSON, stamped with the time of writing."""
    stamped = row.withColumn("preprocessing_date", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    stamped.coalesce(1).write.mode("overwrite").json(path)


def append_quarantine(df: DataFrame, path: str, reason: str, lineage: Sequence[str], order: Sequence[str]) -> None:
    """Append every bad row, by lineage and in order within it, with the reason and the time.

    ``first_per_group`` gives a short view of the result for printing.
    """
    kept = df.repartitionByRange(*lineage, *order).sortWithinPartitions(*lineage, *order)
    kept.withColumns({"reason": F.lit(reason), "logged_at": F.current_timestamp()}).write.mode("append").parquet(path)


def reshuffle(spark: SparkSession, source_path: str, target_path: str, size: int, key: Sequence[str], seed: int) -> DataFrame:
    """Shuffle existing chunks into a new path and return the new manifest row."""
    chunks = spark.read.parquet(source_path).drop("row_index", "chunk_id")
    write_chunks(chunks, target_path, size, key, seed)
    written = spark.read.parquet(target_path)
    assert_same(chunks, written.drop("row_index", "chunk_id"))
    return manifest_row(written, params={"chunk_size": size, "seed": seed, "last_operation_type": "shuffle_only"})
