"""Game records from plain, gzip and bzip2 text, and their labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from ..functions import text as T

# Input endings.
TEXT_ENDINGS = (".pgn", ".pgn.gz", ".pgn.bz2")
ARCHIVE_ENDINGS = (".tar", ".tar.gz", ".tar.bz2", ".tgz", ".tbz2")
ALL_ENDINGS = TEXT_ENDINGS + ARCHIVE_ENDINGS

SOURCE_RULES = (("lichess", "lichess"),)


def ending_pattern(endings: Sequence[str]) -> str:
    return "(?i)(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"


def list_files(spark: SparkSession, path: str, endings: Sequence[str] = ALL_ENDINGS) -> DataFrame:
    """Files below ``path`` by ending, in any letter case. Contents are not read."""
    return listed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), endings)


def listed(files: DataFrame, endings: Sequence[str]) -> DataFrame:
    """Path, name, time and size of the rows of a file source."""
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("bytes"),
    ).where(F.col("file_name").rlike(ending_pattern(endings)))


# A run of line ends before a bracket. One character class, entered once per run: a repeated group would recurse.
BLANK = r"(?<![\r\n])\r?\n[\r\n]*\n(?=\[)"


def _reader(reader, newline: str):
    return (
        reader.option("recursiveFileLookup", "true")
        .option("lineSep", f"{newline}{newline}[")
        .option("ignoreCorruptFiles", "true")
    )


def scan_records(
    spark: SparkSession,
    path: str,
    newline: str = "\n",
    errors: str = "replace",
    endings: Sequence[str] = TEXT_ENDINGS,
) -> DataFrame:
    """One row per game record: ``path, file_name, modified, record_id, text``.

    The text reader cuts files at a blank line followed by ``[``. Plain and bzip2
    files are split between tasks, a gzip file is one task. Files in the other newline
    style reach one record first and are cut afterwards; pass ``newline="\\r\\n"``
    for large ones.
    """
    return _records(_reader(spark.read, newline).text(path), errors, endings)


def stream_records(
    reader: DataStreamReader,
    path: str,
    newline: str = "\n",
    errors: str = "replace",
    endings: Sequence[str] = TEXT_ENDINGS,
    files_per_batch: int = 1000,
) -> DataFrame:
    """The same rows from files as they arrive, without ``record_id``."""
    raw = _reader(reader, newline).option("maxFilesPerTrigger", files_per_batch).text(path)
    return _records(raw, errors, endings, numbered=False)


def _records(raw: DataFrame, errors: str, endings: Sequence[str], numbered: bool = True) -> DataFrame:
    value = F.ltrim(T.decode("value", errors), F.lit("\ufeff"))
    # the separator took the bracket that opens a header block
    value = F.when(value.rlike(r'\A[A-Za-z0-9][^\s"]*\s+"[^\r\n]*"\s*\]'), F.concat(F.lit("["), value)).otherwise(value)
    columns = [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ]
    records = (
        raw.where(F.col("_metadata.file_name").rlike(ending_pattern(endings)))
        .select(*columns, F.explode(F.split(value, BLANK)).alias("text"))
        .where(F.col("text").rlike(r"\S"))
    )
    return records.withColumn("record_id", F.monotonically_increasing_id()) if numbered else records


def parse_records(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``headers, movetext, moves, result, error``. One bad record never drops another.

    A column ``headers`` that is there already is taken as it is.
    """
    if "headers" not in df.columns:
        df = df.withColumn("headers", T.parse_headers(text))
    parsed = df.withColumn("movetext", T.movetext_block(text))
    # Exploded, so that the costly stripping runs once per record: a filter on the error
    # cannot be pushed below it and evaluate it again.
    parsed = parsed.withColumn("__plain", F.explode(F.array(T.strip_movetext("movetext"))))
    parsed = parsed.withColumns({"moves": T.plain_tokens("__plain"), "__end": T.plain_result("__plain")})
    stated = T.header("headers", "Result", "*")
    parsed = parsed.withColumn("result", F.when(stated == "*", F.coalesce("__end", F.lit("*"))).otherwise(stated))
    error = (
        F.when(F.col("__plain").rlike(r"[(){}]"), "unbalanced or too deep variation or comment")
        .when((F.size("headers") == 0) & (F.size("moves") == 0), "neither headers nor moves")
        .when((F.size("moves") == 0) & (F.col("result") == "*"), "no moves and no result")
    )
    return parsed.withColumn("error", error).drop("__end", "__plain")


def split_errors(df: DataFrame, text: str = "text", lines: int = 30) -> tuple[DataFrame, DataFrame]:
    """(good records, quarantine with the first ``lines`` lines of each bad one)."""
    dump = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    bad = df.where(F.col("error").isNotNull()).withColumn("dump", dump)
    return df.where(F.col("error").isNull()).drop("error"), bad


def label_source(
    df: DataFrame,
    name: str | Column = "file_name",
    rules: Sequence[tuple[str, str]] = SOURCE_RULES,
    default: str | None = "lc0",
    out: str = "source",
) -> DataFrame:
    """First rule whose text occurs in the name, ignoring case; else the default."""
    lowered = F.lower(F.col(name) if isinstance(name, str) else name)
    label = F.lit(default)
    for needle, value in reversed(rules):
        label = F.when(lowered.contains(needle), value).otherwise(label)
    return df.withColumn(out, label)


def label_split(df: DataFrame, path: str = "path", out: str = "split", root: str = "") -> DataFrame:
    """``train`` or ``test`` from the first directory of that name below ``root``, NULL when neither occurs."""
    below = F.regexp_replace(path, F.lit(f"^.*?{re.escape(root.rstrip('/'))}(?=/)"), F.lit("")) if root else F.col(path)
    found = F.regexp_extract(below, "/(?:split=)?(train|test)/", 1)
    return df.withColumn(out, F.when(found != "", found))


def unread_files(listing: DataFrame, records: DataFrame) -> DataFrame:
    """Listed files that gave no record: empty or corrupt. The input is never deleted."""
    return listing.join(records.select("path").distinct(), "path", "left_anti")
