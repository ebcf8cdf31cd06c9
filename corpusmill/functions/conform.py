"""Stored and training schemas, and the casts between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One row per position; unsigned types are widened.
POSITION_SCHEMA = {
    "bitboards": "array<smallint>",
    "policy_target": "smallint",
    "legal_mask": "array<smallint>",
    "material_raw": "tinyint",
    "material_category": "tinyint",
    "value_target": "tinyint",
    "ply_target": "int",
    "total_plys_in_game": "smallint",
    "is_960_game": "boolean",
    "side_to_move": "boolean",
    "rep_count_ge1": "boolean",
    "rep_count_ge2": "boolean",
    "source": "string",
}

# What a trainer reads: class targets as bigint, plies as smallint.
TRAIN_SCHEMA = {
    **POSITION_SCHEMA,
    "value_target": "bigint",
    "material_category": "bigint",
    "ply_target": "smallint",
}

FLAG_ALIASES = {
    "is960": "is_960_game",
    "stm": "side_to_move",
    "rep1": "rep_count_ge1",
    "rep2": "rep_count_ge2",
}


def conform(df: DataFrame, schema: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Select and cast to ``schema``; under ANSI mode a value out of range raises."""
    return df.select(*keep, *[F.col(name).cast(kind).alias(name) for name, kind in schema.items()])


def with_defaults(df: DataFrame, defaults: Mapping[str, object], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Fill absent columns and NULLs; ``aliases`` maps a wanted name to a stored one."""
    aliases = aliases or {}
    columns = {}
    for name, value in defaults.items():
        stored = name if name in df.columns else aliases.get(name)
        present = stored in df.columns
        columns[name] = F.coalesce(F.col(stored), F.lit(value)) if present else F.lit(value)
    return df.withColumns(columns)


def source_flags(df: DataFrame) -> DataFrame:
    """The two complementary source booleans of the wire format."""
    lichess = F.col("source") == "lichess"
    return df.withColumns({"is_lichess_game": lichess, "is_lc0_game": ~lichess})
