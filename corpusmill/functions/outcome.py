"""Game results as targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def result_one_hot(result) -> Column:
    """[white wins, draw, black wins]; all zero for anything else."""
    return F.array(*[F.coalesce((_col(result) == r).cast("int"), F.lit(0)) for r in ("1-0", "1/2-1/2", "0-1")])


def outcome_for_mover(result, white_moves) -> Column:
    """0 loss, 1 draw, 2 win for the side to move."""
    return F.when(_col(result) == "1/2-1/2", 1).when((_col(result) == "1-0") == _col(white_moves), 2).otherwise(0)
