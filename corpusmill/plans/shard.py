"""Raw corpus → filtered, split shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_text
from ..operators.index import attach
from ..operators.profile import rollup_totals
from ..operators.quality import keeps
from ..operators.split import hash_split
from ..session import materialize
from ..sources.archives import scan_archives
from ..sources.ranges import RANGE, read_records
from ..sources.records import label_source, parse_records, scan_records
from ..sources.sinks import write_shards

QUARANTINE = "_quarantine"  # readers pass over folders that start so
FATES = ("written", "filtered", "quarantined")


def corpus_records(spark: SparkSession, path: str, errors: str = "replace", range_bytes: int = RANGE) -> DataFrame:
    """Records of every text file and archive below ``path``.

    What can't be read, a file or its end, an archive or a member, is a row with its reason in ``unread``.
    """
    columns = ["path", "file_name", "member", "text", "record_id", "unread"]
    missing = F.lit(None).cast("string")
    plain = read_records(spark, path, errors, range_bytes=range_bytes).withColumnRenamed("damage", "unread").withColumn("member", missing)
    packed = scan_archives(spark, path, errors).withColumnRenamed("error", "unread")
    packed = packed.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    packed = packed.withColumn("record_id", F.xxhash64("path", "member", "record_no"))
    return plain.select(*columns).unionByName(packed.select(*columns))


def judged(records: DataFrame, fraction: float, seed: int = 42, chars: int = 2, rules="strict") -> DataFrame:
    """``path, member, record_id, source, split, fate, reason, text`` of every record.

    ``fate`` is written, filtered or quarantined. The text is canonical in written records, as read in quarantined ones
    and left out of filtered ones. One narrow stage: nothing is exchanged.
    """
    parsed = parse_records(label_source(records))
    unread = F.col("unread") if "unread" in records.columns else F.lit(None).cast("string")
    reason = F.coalesce(unread, "error")
    fate = F.when(reason.isNotNull(), "quarantined").when(keeps(rules), "written").otherwise("filtered")
    told = parsed.withColumns({"reason": reason, "fate": fate, "__canonical": canonical_text("text")})
    split = hash_split(told, "__canonical", fraction, seed, chars)
    text = F.when(F.col("fate") == "written", F.col("__canonical")).when(F.col("fate") == "quarantined", F.col("text"))
    missing = [F.lit(None).cast("string").alias(c) for c in ("path", "member") if c not in records.columns]
    return split.select(
        *[c for c in ("path", "member") if c in records.columns], *missing, "record_id", "source", "split", "fate", "reason", text.alias("text")
    )


def written_records(told: DataFrame) -> DataFrame:
    return told.where("fate = 'written'").select("record_id", "split", "source", "text")


def quarantined_records(told: DataFrame) -> DataFrame:
    return told.where("fate = 'quarantined'").select("path", "member", "reason", "text")


def fate_totals(told: DataFrame, keys=("split", "source")) -> DataFrame:
    """Records read and each fate's, per group with all subtotals."""
    counts = [F.count_if(F.col("fate") == fate).alias(fate) for fate in FATES]
    return told.rollup(*keys).agg(F.count(F.lit(1)).alias("read"), *counts, F.grouping_id().cast("bigint").alias("level"))


def reconciled(told: DataFrame, shards: DataFrame, keys=("split", "source")) -> DataFrame:
    """``rows`` counted from what was written beside the totals of ``told``, and whether all of it agrees."""
    totals = attach(fate_totals(told, keys), rollup_totals(shards, list(keys)), [*keys, "level"], "left")
    rows = F.coalesce("rows", F.lit(0))
    agrees = (F.col("read") == F.col("written") + F.col("filtered") + F.col("quarantined")) & (rows == F.col("written"))
    return totals.withColumns({"rows": rows, "agrees": agrees})


def shard_corpus(
    spark: SparkSession,
    path: str,
    out: str,
    fraction: float = 0.0,
    seed: int = 42,
    chars: int = 2,
    records_per_shard: int = 5000,
    rules="strict",
    observation: Observation | None = None,
    range_bytes: int = RANGE,
) -> DataFrame:
    """Write the shards and return totals per split and source, see ``reconciled``.

    The input is read and parsed once, into a table of all records with their fates; shards, ``_quarantine`` in ``out``
    (path, member, reason, text) and totals come from that table.
    """
    told = materialize(judged(corpus_records(spark, path, "ignore", range_bytes), fraction, seed, chars, rules), "judged")
    shards = written_records(told)
    if observation is not None:
        shards = shards.observe(observation, F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).alias("chars"))
    write_shards(shards, out, records_per_shard)
    quarantined_records(told).write.parquet(f"{out}/{QUARANTINE}")
    return reconciled(told, from_shards(scan_records(spark, out, endings=(".txt",))))


def from_shards(records: DataFrame) -> DataFrame:
    """Split and source of shard records, from their folders."""
    return records.withColumns(
        {
            "split": F.regexp_extract("path", "/split=([^/]+)/", 1),
            "source": F.regexp_extract("path", "/source=([^/]+)/", 1),
        }
    )
