"""Train and test: by content, or by whole files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import chosen_suffixes, content_suffix, seeded_hash
from .index import attach
from .sequence import first_per_group

MAX_INLINE = 256


def hash_split(df: DataFrame, text: str, fraction: float, seed: int = 42, chars: int = 2, out: str = "split") -> DataFrame:
    """``test`` when the SHA-1 of the text ends in a chosen suffix: equal texts share a side."""
    if chars not in (2, 3, 4):
        raise ValueError("chars is 2, 3 or 4")
    suffixes = chosen_suffixes(fraction, seed, chars)
    if not suffixes:
        return df.withColumn(out, F.lit("train"))
    suffix = content_suffix(text, chars)
    if len(suffixes) <= MAX_INLINE:
        return df.withColumn(out, F.when(suffix.isin(*suffixes), "test").otherwise("train"))
    # at most 16**4 suffixes exist, so this table has a fixed bound
    marked = df.sparkSession.createDataFrame([(s, True) for s in suffixes], "__suffix string, __test boolean")
    joined = df.withColumn("__suffix", suffix).join(F.broadcast(marked), "__suffix", "left")
    return joined.withColumn(out, F.when(F.col("__test"), "test").otherwise("train")).drop("__suffix", "__test")


def holdout_files(
    manifest: DataFrame, n: int, by: Sequence[str] = ("source",), seed: int = 42, path: str = "path", out: str = "split"
) -> DataFrame:
    """Marks ``n`` random files per group as test; all of them when there are fewer."""
    chosen = held_out(manifest, n, by, seed, path).select(path, F.lit("test").alias("__held"))
    marked = attach(manifest, chosen, [path], "left")
    return marked.withColumn(out, F.coalesce("__held", F.lit("train"))).drop("__held")


def held_out(manifest: DataFrame, n: int, by: Sequence[str], seed: int, path: str) -> DataFrame:
    hashed = manifest.withColumn("__h", seeded_hash(seed, path))
    return first_per_group(hashed, by, ["__h", path], n).drop("__h")


def holdout_shortfall(manifest: DataFrame, n: int, by: Sequence[str] = ("source",)) -> DataFrame:
    """Groups with fewer than ``n`` files, for a warning."""
    return manifest.groupBy(*by).agg(F.count(F.lit(1)).alias("available")).where(F.col("available") < n)


def remaining(df: DataFrame, held: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file was not held out."""
    return df.join(held.select(path).distinct(), path, "left_anti")
