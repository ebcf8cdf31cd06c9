"""Replaying games: one row per game in, one row per ply out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship_package
from ._rules import replay

PLY_FIELDS = (
    T.StructType()
    .add("ply", T.IntegerType())
    .add("total_plys", T.IntegerType())
    .add("fen", T.StringType())
    .add("move_from", T.IntegerType())
    .add("move_to", T.IntegerType())
    .add("promotion", T.StringType())
    .add("legal", T.ArrayType(T.IntegerType()))
    .add("rep_count", T.IntegerType())
    .add("is_960", T.BooleanType())
    .add("error", T.StringType())
)
# rows per Arrow batch: bounds a task's memory whatever the games' lengths
BATCH = 2048
PROMOTIONS = ["", "n", "b", "r", "q"]


def replay_games(
    games: DataFrame, carry: Sequence[str], moves: str = "moves", fen: str | None = None, variant: str | None = None
) -> DataFrame:
    """The ``carry`` columns repeated for each ply, with the position before the move.

    ``rep_count`` is the number of earlier visits to the same position in the game. A
    game with an unplayable move gives a single row with ``error`` and no ply, so put
    filters before this step: they cannot pass it.
    """
    columns = [F.col(c) for c in carry] + [
        F.col(moves).alias("__moves"),
        (F.col(fen) if fen else F.lit(None).cast("string")).alias("__fen"),
        (F.col(variant) if variant else F.lit(None).cast("string")).alias("__variant"),
    ]
    slim = games.select(*columns)
    schema = T.StructType([slim.schema[c] for c in carry] + PLY_FIELDS.fields)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    names = list(carry)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for game in batch.to_pylist():
            kept = [game[c] for c in names]
            tokens = game["__moves"]
            try:
                plies = list(replay(tokens, game["__fen"], game["__variant"]))
            except (ValueError, IndexError) as problem:  # unplayable move or broken start
                yield (*kept, None, len(tokens), None, None, None, None, None, None, None, str(problem))
                continue
            for ply, (before, move, legal, seen, shuffled) in enumerate(plies):
                if move is None:
                    src = dst = promotion = None
                else:
                    src, dst, promotion = move & 63, move >> 6 & 63, PROMOTIONS[move >> 12] or None
                yield (*kept, ply, len(plies), before, src, dst, promotion, legal, seen, shuffled, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in rows(batch):
                held.append(row)
                if len(held) == BATCH:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(values, type=field.type) for values, field in zip(zip(*held), arrow)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    ship_package(games.sparkSession)
    return slim.mapInArrow(run, schema)
