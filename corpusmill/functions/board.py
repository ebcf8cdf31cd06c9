"""Board features from a FEN string, as native expressions.

Planes are sparse: an ``array<smallint>`` of ``plane * 64 + square`` for the set bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .losses import let

# Piece order, material, castling corners and plane numbers.
PIECES = "PNBRQKpnbrqk"
MATERIAL = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9, "K": 0}
CASTLING_CORNERS = {"Q": 0, "K": 7, "q": 56, "k": 63}
CASTLING_PLANE = 12
EN_PASSANT_PLANE = 13
BOARD_PLANES = 14


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fen_field(fen, number: int) -> Column:
    return F.split_part(_col(fen), F.lit(" "), F.lit(number))


def square_index(name) -> Column:
    """``e4`` → 28; NULL for ``-`` or an empty string."""
    text = _col(name)
    value = (F.substring(text, 2, 1).try_cast("int") - 1) * 8 + F.ascii(text) - F.lit(ord("a"))
    return F.when(text.rlike("^[a-h][1-8]$"), value).cast("int")


def expand_placement(placement) -> Column:
    """64 characters from a8 to h1, ``.`` for an empty square."""
    text = F.replace(_col(placement), F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit(str(n)), F.lit("." * n))
    return text


def _set_bits(placement: Column) -> Column:
    cells = F.split(expand_placement(placement), "")
    # Character i shows square i xor 56, as FEN starts at rank 8. An empty cell has
    # position 0 and so a negative bit.
    bits = F.transform(cells, lambda c, i: (F.position(c, F.lit(PIECES)) - 1) * 64 + i.bitwiseXOR(F.lit(56)))
    return F.filter(bits, lambda b: b >= 0)


def board_planes(fen) -> Column:
    """Set bits of the 14 planes: six white pieces, six black, castling rights, en passant."""
    castling = fen_field(fen, 3)
    rights = F.array(
        *[
            F.when(castling.contains(letter), F.lit(CASTLING_PLANE * 64 + corner))
            for letter, corner in CASTLING_CORNERS.items()
        ]
    )
    passant = F.array(square_index(fen_field(fen, 4)) + EN_PASSANT_PLANE * 64)
    flags = F.array_compact(F.concat(rights, passant))
    # piece planes come before the flag planes
    return F.concat(F.sort_array(_set_bits(fen_field(fen, 1))), F.sort_array(flags)).cast("array<smallint>")


def white_to_move(fen) -> Column:
    return fen_field(fen, 2) == "w"


def material_balance(placement) -> Column:
    """White minus black, in pawns."""
    text = _col(placement)

    def count(piece: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))

    total = F.lit(0)
    for piece, worth in MATERIAL.items():
        if worth:
            total = total + worth * (count(piece) - count(piece.lower()))
    return total.cast("int")


def material_category(balance) -> Column:
    """0..10: the balance clamped to ±5, shifted by 5."""
    return (F.least(F.greatest(_col(balance), F.lit(-5)), F.lit(5)) + 5).cast("int")


def flip(bits, kind: str) -> Column:
    """Mirror sparse planes: ``h`` swaps files, ``v`` swaps ranks and colours, ``hv`` both."""
    if kind not in ("h", "v", "hv"):
        raise ValueError("kind is h, v or hv")
    mask = (7 if "h" in kind else 0) + (56 if "v" in kind else 0)

    def mirror(bit: Column) -> Column:
        moved = bit.cast("int").bitwiseXOR(F.lit(mask))
        if "v" not in kind:
            return moved
        return F.when(bit < 6 * 64, moved + 6 * 64).when(bit < 12 * 64, moved - 6 * 64).otherwise(moved)

    return F.array_sort(F.transform(_col(bits), mirror)).cast("array<smallint>")


def to_dense(bits, size: int) -> Column:
    """0/1 array of a sparse bit list, for export."""
    cells = F.sequence(F.lit(0), F.lit(size - 1))
    return let(_col(bits).cast("array<int>"), lambda b: F.transform(cells, lambda i: F.array_contains(b, i).cast("int")))


def to_sparse(dense) -> Column:
    """Positions of the non-zero entries of a dense array."""
    marked = F.transform(_col(dense), lambda x, i: F.when(x != 0, i))
    return F.filter(marked, lambda i: i.isNotNull()).cast("array<smallint>")
