"""Metric series → the rows a training report shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import every_nth, rolling_mean


def metric_report(metrics: DataFrame, window: int = 1000, every: int = 100) -> DataFrame:
    """Rolling mean of each metric of each run, at every n-th step. ``metrics(run, step, name, value)``."""
    means = rolling_mean(metrics, ["run", "name"], ["step"], "value", window)
    return every_nth(means, "step", every).select("run", F.col("step"), "name", "rolling_mean")
