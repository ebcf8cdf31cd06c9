"""Losses over prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import losses as L

LOSSES = ["policy", "value", "moves_left", "auxiliary_value", "material", "total", "compare_lc0"]
EQUAL_WEIGHTS = {"policy": 1.0, "value": 1.0, "moves_left": 1.0, "auxiliary_value": 1.0, "material": 1.0}


def row_losses(df: DataFrame, weights: Mapping[str, object] = EQUAL_WEIGHTS, smoothing: float = L.SMOOTHING) -> DataFrame:
    """Seven losses per row from logits and targets standing side by side."""
    single = df.withColumns(
        {
            "policy": L.masked_policy_loss("policy_logits", "legal_mask", "policy_target"),
            "value": L.smoothed_cross_entropy("value_logits", "value_target", smoothing),
            "moves_left": L.scaled_huber("ply_pred", "ply_target"),
            "auxiliary_value": L.smoothed_cross_entropy("early_value_logits", "value_target", smoothing),
            "material": L.cross_entropy("material_logits", "material_category"),
        }
    )
    return single.withColumns({"total": L.weighted_sum(dict(weights)), "compare_lc0": L.weighted_sum(L.COMPARISON)})


def evaluate(
    predictions: DataFrame,
    targets: DataFrame,
    on: Sequence[str] = ("row_id",),
    by: Sequence[str] = (),
    weights: Mapping[str, object] = EQUAL_WEIGHTS,
    include_padding: bool = False,
) -> DataFrame:
    """Mean of each loss over all rows, or per group. Padding rows count only on request; no row gives 0."""
    joined = predictions.join(targets, list(on))
    if "source_index" in joined.columns and not include_padding:
        joined = joined.where(F.col("source_index") >= 0)
    means = [F.coalesce(F.avg(name), F.lit(0.0)).alias(name) for name in LOSSES]
    return row_losses(joined, weights).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *means)


def split_finite(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose columns are all finite, rows with a NaN or an infinity)."""
    bad = F.lit(False)
    for name in columns:
        value = F.col(name).cast("double")
        bad = bad | F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    return df.where(~bad), df.where(bad)
