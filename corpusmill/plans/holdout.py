"""Chunks → held-out files, and how their distributions compare with the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import OUTCOME_LABELS, category_distribution, compare_distributions, plane_usage
from ..operators.sampling import two_stage_sample
from ..operators.split import held_out, remaining
from ..session import materialize
from ..sources.chunks import file_manifest


def holdout_profile(
    spark: SparkSession, chunks: str, n: int = 3, draws: int = 500, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held-out files, outcome comparison, plane comparison) over all sources of a chunk folder.

    Only the two target columns are read for the profiles.
    """
    scan = spark.read.parquet(chunks)
    rows = scan.select(
        "source", "value_target", "policy_target",
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_no"),
    )
    manifest = file_manifest(scan)
    labelled = manifest.withColumn("source", F.regexp_extract("path", "/source=([^/]+)/", 1))
    held = materialize(held_out(labelled, n, ["source"], seed, "path"), "held")
    test = rows.join(held.select("path"), "path", "left_semi")
    train = two_stage_sample(remaining(rows, held), "path", ["row_no"], draws, seed)
    outcome = compare_distributions(
        category_distribution(test, "value_target", OUTCOME_LABELS),
        category_distribution(train, "value_target", OUTCOME_LABELS),
        "category",
    )
    planes = compare_distributions(
        plane_usage(test, "policy_target", 73), plane_usage(train, "policy_target", 73), "plane"
    )
    return held, outcome, planes
