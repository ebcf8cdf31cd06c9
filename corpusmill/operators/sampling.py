"""Samples of files and rows, reproducible by seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw, seeded_hash
from ..session import materialize
from ..sources.chunks import list_chunks
from ..sources.footers import read_footers
from .groups import ranked
from .index import hash_ranked, row_hash, running_totals, sorted_table, with_global_index


def two_stage_sample(
    df: DataFrame, file: str, order: Sequence[str], n: int, seed: int, mode: str = "file"
) -> DataFrame:
    """``n`` draws with replacement; adds ``draw_id``.

    ``file``: a uniform file, then a uniform row of it, so rows of small files weigh
    more. ``uniform``: every row has the same weight.
    """
    spark = df.sparkSession
    draws = spark.range(n).select(F.col("id").alias("draw_id"))
    file_hash = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw_id").cast("string"), F.lit("f")))
    row_hash = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw_id").cast("string"), F.lit("r")))
    if mode == "uniform":
        # the index stands on a written table, so counting it is cheap
        rows = with_global_index(df, [file, *order], "__pick")
        total = rows.count()
        picks = draws.withColumn("__pick", draw(row_hash, total))
        return rows.join(picks, "__pick").drop("__pick") if total else rows.withColumn("draw_id", F.lit(0)).limit(0)
    counts = df.groupBy(file).agg(F.count(F.lit(1)).alias("__rows"))
    files = with_global_index(counts, [file], "__ordinal")
    total = files.count()
    if not total:
        return df.withColumn("draw_id", F.lit(0).cast("bigint")).limit(0)
    picks = (
        draws.withColumn("__ordinal", draw(file_hash, total))
        .join(files, "__ordinal")
        .withColumn("__row", draw(row_hash, F.col("__rows")))
        .select("draw_id", F.col(file).alias("__file"), "__row")
    )
    # only files that were drawn are numbered
    drawn = df.join(picks.select(F.col("__file").alias(file)).distinct(), file, "left_semi")
    rows = ranked(drawn, [file], order, "__rn")
    hit = (rows[file] == picks["__file"]) & (rows["__rn"] == picks["__row"] + 1)
    return rows.join(picks, hit).drop("__file", "__row", "__rn")


def sample_files(spark: SparkSession, path: str, n: int, seed: int, mode: str = "file", columns: Sequence[str] | None = None) -> DataFrame:
    """``n`` draws with replacement from the Parquet files below ``path``, by their rows' places; adds ``draw_id``.

    ``file``: a uniform file, then a uniform row of it. ``uniform``: every row has the same weight. Files are in the order of
    their paths. Row counts come from the footers, so of the data only the files that were drawn, ``n`` at most, are
    read, and nothing of it is sorted or written.
    """
    counted = read_footers(list_chunks(spark, path)).where("rows > 0").select("path", "rows")
    files = sorted_table(counted, ["path"])
    before = Window.partitionBy("__file").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.groupBy("__file").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("r"))
    ranges = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of the listing
    earlier = [F.coalesce(F.sum(c).over(ranges), F.lit(0)).alias(f"before_{c}") for c in ("n", "r")]
    placed = files.join(F.broadcast(offsets.select("__file", *earlier)), "__file").select(
        "path", "rows", (F.col("before_n") + F.col("__pos")).alias("ordinal"),
        (F.col("before_r") + F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("first"),
    )
    placed = materialize(placed, "file_places")
    n_files, total = placed.agg(F.count(F.lit(1)), F.sum("rows")).first()
    if not total:
        raise ValueError(f"no rows below {path}")

    def hashed(mark: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw_id").cast("string"), F.lit(mark)))

    draws = spark.range(n).select(F.col("id").alias("draw_id"))
    if mode == "uniform":
        # files cut into even steps of the whole, so that a draw finds its file by equality
        step = max(1, total // n_files)
        steps = F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("rows") - 1) / step))).alias("step")
        at = draws.withColumn("at", draw(hashed("r"), total)).withColumn("step", F.floor(F.col("at") / step))
        found = at.join(placed.select("path", "rows", "first", steps), "step").where("at >= first AND at < first + rows")
        picks = found.select("draw_id", "path", (F.col("at") - F.col("first")).alias("row"))
    else:
        picks = draws.withColumn("ordinal", draw(hashed("f"), n_files)).join(placed, "ordinal")
        picks = picks.select("draw_id", "path", draw(hashed("r"), F.col("rows")).alias("row"))
    picks = materialize(picks, "picks")
    drawn = [r.path for r in picks.select("path").distinct().collect()]  # n at most
    rows = spark.read.option("basePath", path).parquet(*drawn)
    names = list(columns or rows.columns)
    rows = rows.select(*names, F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    hit = picks.select("draw_id", F.col("path").alias("__path"), F.col("row").alias("__row"))
    return rows.join(hit, ["__path", "__row"]).select("draw_id", *names)


def cap_rows(df: DataFrame, file: str, key: Sequence[str], maximum: int, seed: int) -> DataFrame:
    """At most ``maximum`` rows in file order; the file that crosses the limit is sampled without replacement."""
    counts = df.groupBy(file).agg(F.count(F.lit(1)).alias("__rows"))
    totals = running_totals(counts, [file], "__rows", "__upto")
    whole = totals.where(F.col("__upto") <= maximum).select(file)
    crossing = totals.where((F.col("__upto") > maximum) & (F.col("__upto") - F.col("__rows") < maximum))
    crossing = crossing.select(file, (F.lit(maximum) - (F.col("__upto") - F.col("__rows"))).alias("__left"))
    kept = df.join(whole, file, "left_semi")
    part = hash_ranked(df.join(F.broadcast(crossing), file), key, seed, [file], "__i")  # one file at most
    return kept.unionByName(part.where(F.col("__i") < F.col("__left")).select(*kept.columns))


def file_order(manifest: DataFrame, seed: int, path: str = "path", out: str = "file_ordinal") -> DataFrame:
    """Files in a seeded random order, numbered from 0."""
    return hash_ranked(manifest, [path], seed, out=out)


def epochs(manifest: DataFrame, k: int, seed: int, path: str = "path") -> DataFrame:
    """Each file once per epoch, in a fresh order each time."""
    repeated = manifest.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return hash_ranked(repeated, ["epoch", path], seed, ["epoch"], "position")


def shard_index(df: DataFrame, ordinal: str, workers: int, out: str = "shard_index") -> DataFrame:
    """Round-robin reader number."""
    return df.withColumn(out, F.pmod(F.col(ordinal), F.lit(workers)))


def even_parts(df: DataFrame, index: str, parts: int, total: int, out: str = "part") -> DataFrame:
    """Consecutive parts of a dense index; the first ``total % parts`` get one row more."""
    base, extra = divmod(total, parts)
    edge = extra * (base + 1)
    i = F.col(index)
    small = F.lit(extra) if base == 0 else extra + F.floor((i - edge) / base)
    return df.withColumn(out, F.when(i < edge, F.floor(i / (base + 1))).otherwise(small).cast("bigint"))


def global_shuffle(df: DataFrame, key: Sequence[str], seed: int, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by md5(seed|key), equal keys by their whole rows: one exchange, same order."""
    order = ["__h", "__tie"]
    hashed = df.withColumns({"__h": seeded_hash(seed, *key), "__tie": row_hash(df)})
    ranged = hashed.repartitionByRange(partitions, *order) if partitions else hashed.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).drop(*order)
