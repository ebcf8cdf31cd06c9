"""Numpy views of many texts at once: words, range hashes, and groups of texts of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: One random 64-bit value per byte.
BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def groups(lengths: Sequence[int], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold ``limit`` bytes together, or a single longer text."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def released(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``rows``, but after every batch its freed memory goes back to the system.

    Workers live on from task to task, and what one operator has freed would else stay with each of them.
    """

    def run(batches: Iterator) -> Iterator:
        for result in rows(batches):
            yield result
            del result
            release()
        release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


class Joined:
    """Texts in one byte array; text ``i`` is at ``starts[i]:ends[i]``, then one newline."""

    def __init__(self, texts: Sequence[bytes]):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = powers(len(self.bytes) + 1)
            self._sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUES[self.bytes] * up[:-1], out=self._sums[1:])
        return self._sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit fingerprint of each byte range; equal bytes have equal ones anywhere."""
        _, down = powers(len(self.bytes) + 1)
        return mixed((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * BASE)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each run of other bytes than ASCII white space."""
        edge = np.diff(np.concatenate(([True], SPACE[self.bytes], [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        return starts, ends, np.searchsorted(self.ends, starts)


def shingles(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and owner of each run of ``size`` words within one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * BASE + hashes[k : k + n]
    inside = owner[:n] == owner[size - 1 :]
    return mixed(total[inside]), owner[:n][inside]
