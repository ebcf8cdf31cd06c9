"""Moves and the 73 policy planes. Squares are 0..63, ``rank * 8 + file``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plane layout.
# rays: direction * 7 + distance - 1, directions N NE E SE S SW W NW
# knight jumps: 56..63 in the order of KNIGHT_JUMPS (rank step, file step)
# under-promotions: 64 + 3 * piece + file step + 1
RAY_DIRECTIONS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
KNIGHT_JUMPS = [(-2, -1), (-2, 1), (-1, -2), (-1, 2), (1, -2), (1, 2), (2, -1), (2, 1)]
UNDER_PROMOTIONS = ["n", "b", "r"]
PLANES = 73


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _steps(src: Column, dst: Column) -> tuple[Column, Column]:
    rank = F.shiftright(dst, 3) - F.shiftright(src, 3)
    return rank, dst.bitwiseAND(F.lit(7)) - src.bitwiseAND(F.lit(7))


def _step_table() -> list[int]:
    """Plane of a step at ``(rank step + 7) * 15 + file step + 7``; −1 where no piece moves so."""
    table = [-1] * 225
    for plane, (dr, df) in enumerate(KNIGHT_JUMPS, start=56):
        table[(dr + 7) * 15 + df + 7] = plane
    for direction, (dr, df) in enumerate(RAY_DIRECTIONS):
        for distance in range(1, 8):
            table[(dr * distance + 7) * 15 + df * distance + 7] = direction * 7 + distance - 1
    return table


def _step_plane(src: Column, dst: Column) -> Column:
    dr, df = _steps(src, dst)
    # a foldable text keeps the table one literal in the plan
    table = F.split(F.lit(" ".join(map(str, _step_table()))), " ").cast("array<int>")
    return F.get(table, dr * 15 + df + 112)


def base_plane(src, dst) -> Column:
    """Ray or knight plane of a pair of squares, NULL when neither."""
    return F.nullif(_step_plane(_col(src).cast("int"), _col(dst).cast("int")), F.lit(-1))


def under_promotion_plane(src, dst, promotion) -> Column:
    """Plane 64..72 of a pawn promotion to knight, bishop or rook, else NULL."""
    src, dst = _col(src).cast("int"), _col(dst).cast("int")
    dr, df = _steps(src, dst)
    rank = F.shiftright(src, 3)
    piece = F.array_position(F.lit(UNDER_PROMOTIONS), F.lower(_col(promotion))).cast("int") - 1
    last_step = ((rank == 6) & (dr == 1)) | ((rank == 1) & (dr == -1))
    return F.when(last_step & (F.abs(df) <= 1) & (piece >= 0), 64 + 3 * piece + df + 1).cast("int")


def move_plane(src, dst, promotion=None) -> Column:
    """Plane 0..72 of a move, NULL when the layout has no place for it."""
    plane = base_plane(src, dst)
    return plane if promotion is None else F.coalesce(under_promotion_plane(src, dst, promotion), plane)


def policy_index(src, dst, promotion=None) -> Column:
    """Flat index ``plane * 64 + from`` of a move."""
    return (move_plane(src, dst, promotion) * 64 + _col(src).cast("int")).cast("smallint")


# Packed moves keep legal-move lists small: from + 64 * to + 4096 * promotion,
# promotion 0 for none and 1..4 for knight, bishop, rook, queen.
PACKED_PROMOTIONS = ["", "n", "b", "r", "q"]


def packed_policy_index(code: Column) -> Column:
    """Policy index of a packed move, negative when it has no plane."""
    src, dst = code.bitwiseAND(F.lit(63)), F.shiftright(code, 6).bitwiseAND(F.lit(63))
    piece = F.shiftright(code, 12)
    df = dst.bitwiseAND(F.lit(7)) - src.bitwiseAND(F.lit(7))
    # packed promotions 1, 2, 3 are always a pawn's last step
    under = 64 + 3 * (piece - 1) + df + 1
    return F.when(piece.between(1, 3), under).otherwise(_step_plane(src, dst)) * 64 + src


def legal_mask(codes) -> Column:
    """Sorted flat indices of legal moves packed as above."""
    indices = F.filter(F.transform(_col(codes), packed_policy_index), lambda i: i >= 0)
    return F.sort_array(F.array_distinct(indices)).cast("array<smallint>")
