"""Seeded, engine-independent hashing. md5 and sha1 give the same digits everywhere."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed, *cols) -> Column:
    """md5 of ``seed|col|col…``: a reproducible random order for unique keys."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def draw(digest: Column, n) -> Column:
    """A number in [0, n) from the first 60 bits of a hex digest."""
    bits = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return F.pmod(bits, n if isinstance(n, Column) else F.lit(int(n)))


def content_suffix(text, chars: int) -> Column:
    """The last ``chars`` hex digits of the SHA-1 of the text."""
    return F.substring(F.sha1(F.col(text) if isinstance(text, str) else text), -chars, chars)


def chosen_suffixes(fraction: float, seed: int = 42, chars: int = 2) -> list[str]:
    """The hex suffixes that mark held-out content; empty when the fraction disables the split."""
    if not 0 < fraction < 1:
        return []
    space = 16**chars
    wanted = max(1, round(space * fraction))
    return sorted(random.Random(seed).sample([f"{i:0{chars}x}" for i in range(space)], wanted))
