"""Operator 7: SentencePiece models as weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (dummy prefix, spaces to the space
mark), the pieces with their byte fallback, and for BPE models an acceptor of neighbouring pieces
that merging would leave apart. Composed with a text they give a lattice whose shortest path in the
tropical semiring is the encoding. Decoding runs the pieces the other way.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship_package

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model format
COLUMNS = "n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if key & 7 == 2 else ({5: 4, 1: 8}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """The parts of a model file that encoding needs."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.prefix, normaliser, charsmap, extra = False, True, "", b"", True
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append((part[1].decode(), struct.unpack("<f", part[2])[0], part.get(3, NORMAL)))
            elif field == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                part = dict(_fields(value))
                normaliser, charsmap = part.get(1, b"").decode(), part.get(2, b"")
                self.prefix, extra = bool(part.get(3, 1)), bool(part.get(4, 1))
        if charsmap or normaliser not in ("", "identity") or extra:
            raise ValueError("only models with the identity normaliser that keep all spaces are supported")
        if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for *_, kind in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")


class Transducer:
    LIMIT, LONGEST = 400_000, 64  # words that a task remembers, and their length

    def __init__(self, data: bytes):
        model = Model(data)
        self.model, self.bpe, self.prefix = model, model.bpe, model.prefix
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = next(i for i, (*_, kind) in enumerate(model.pieces) if kind == UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.lengths = self._lengths()
        worst = min(self.score.values())
        self.fallback = 10.0 - worst  # an unknown character costs more than any piece
        self.names = [p for p, *_ in model.pieces]
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        # where no piece can go across: before a run of space marks, and around a line break
        splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        if not splits:
            self.words = re.compile("(?s).+")
        elif any("\n" in p for p in self.ids):
            self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def _lengths(self) -> dict[str, list[int]]:
        """Lengths, long ones first, of the pieces that can start where these three, or last one or two, characters are."""
        found: dict[str, set[int]] = {}
        for p in self.ids:
            found.setdefault(p[:3], set()).add(len(p))
        return {key: sorted(own.union(n for n in (1, 2) if key[:n] in self.ids and n <= len(key)), reverse=True) for key, own in found.items()}

    def lengths_at(self, word: str, at: int) -> list[int] | tuple[int, ...]:
        for key in (word[at : at + 3], word[at : at + 2], word[at]):
            found = self.lengths.get(key)
            if found is not None:
                return found
        return ()

    # the normaliser

    def normalised(self, text: str) -> str:
        marked = text.replace(" ", SPACE)
        return SPACE + marked if self.prefix and text else marked

    # the acceptor of neighbours

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by merging the best pair, of equal ones the leftmost, again and again."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(range(len(scores)), key=scores.__getitem__)
            if scores[best] == -np.inf:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def neighbours(self, left: str, right: str) -> bool:
        """Whether merging leaves ``left`` and ``right`` as they are; ``left`` is empty after anything else than a piece."""
        if len(self.apart) > 4 * self.LIMIT:
            self.apart.clear()
        found = self.apart[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    # composition and shortest path

    def path(self, word: str) -> list[int]:
        """Ids along the cheapest path through the lattice of ``word``."""
        ids: list[int] = []
        for piece in self._only_path(word) if self.bpe else self._best_path(word):
            one = self.ids.get(piece)
            if one is not None:
                ids.append(one)
            else:
                ids.extend([self.byte_ids.get(b, self.unknown) for b in piece.encode()])
        return ids

    def _only_path(self, word: str) -> list[str]:
        """With the acceptor of neighbours just one path leads to any place: the encoding up to there.

        So the lattice is composed depth first, long pieces first, and a place without a way to the
        end is left for good; the first path to the end is the only and therefore the shortest one.
        """
        n, at, before = len(word), 0, ""
        path: list[str] = []
        dead: set[int] = set()
        ids, lengths, apart = self.ids, self.lengths, self.apart
        while at < n:
            first = word[at]
            for length in lengths.get(word[at : at + 3]) or self.lengths_at(word, at):
                end = at + length
                if end > n or end in dead:
                    continue
                piece = word[at:end]
                if piece in ids:
                    fits = apart.get((before, piece))
                    if fits is None:
                        fits = self.neighbours(before, piece)
                    if fits:
                        break
            else:
                if first not in ids and at + 1 not in dead:
                    piece, end = first, at + 1
                elif path:
                    dead.add(at)
                    at -= len(path.pop())
                    before = path[-1] if path and path[-1] in ids else ""
                    continue
                else:
                    raise ValueError("no path")
            path.append(piece)
            at, before = end, piece if piece in ids else ""
        return path

    def _best_path(self, word: str) -> list[str]:
        """Unigram models: least sum of weights, the negative scores, place by place."""
        n = len(word)
        infinite = float("inf")
        cost = array("d", [0.0]) + array("d", [infinite]) * n
        back = array("i", [0]) * (n + 1)
        for start in range(n):
            here = cost[start]
            for length in self.lengths_at(word, start):
                piece = word[start : start + length]
                if len(piece) == length and piece in self.ids and here - self.score[piece] < cost[start + length]:
                    cost[start + length], back[start + length] = here - self.score[piece], start
            if word[start] not in self.ids and here + self.fallback < cost[start + 1]:
                cost[start + 1], back[start + 1] = here + self.fallback, start
        path: list[str] = []
        end = n
        while end > 0:
            path.append(word[back[end] : end])
            end = back[end]
        return path[::-1]

    def _packed(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = np.array(self.path(word), dtype="<u4").tobytes()
            if len(word) <= self.LONGEST:
                if len(self.known) >= self.LIMIT:
                    self.known.clear()
                self.known[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        words = self.words.findall(self.normalised(text))
        return np.frombuffer(b"".join(map(self._packed, words)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids vanish, bytes are read as UTF-8, one space is taken off the front."""
        table = self._outputs()
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _outputs(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            out = {CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
            self._table = [out.get(kind, lambda p: p.replace(SPACE, " ").encode())(p) for p, _, kind in self.model.pieces]
        return self._table


_ready: dict[bytes, Transducer] = {}


def transducer(data: bytes) -> Transducer:
    """One for each worker process, so that words are remembered from task to task."""
    key = hashlib.sha256(data).digest()
    if key not in _ready:
        _ready.clear()
        _ready[key] = Transducer(data)
    return _ready[key]


def _over_texts(df: DataFrame, data: bytes, column: str, schema: str, row) -> DataFrame:
    """``df`` with the columns of ``schema`` that ``row(transducer, value)`` gives."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(data)  # the model file, 0.5 MB
    names = [c.strip().split()[0] for c in schema.split(", ")]
    kept = [c for c in df.columns if c not in names]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(shared.value)
        for batch in batches:
            made = [row(machine, x) for x in batch[column]]
            out = batch[keep].copy()
            for k, name in enumerate(names):
                out[name] = [m[k] for m in made]
            yield out

    keep = [c for c in kept if c != column]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return df.select(*keep, column).mapInPandas(rows, f"{types}, {schema}" if types else schema)


def encode(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``ids``. Null and empty texts have none; long words are read to their end."""
    return _over_texts(df, model, text, "ids array<bigint>", lambda t, x: (t.encode(x or "").astype(np.int64),))


def decode(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Replace ``ids`` by ``text``; null ids are an empty text."""
    return _over_texts(df, model, ids, "text string", lambda t, x: (t.decode(np.array([] if x is None else x, dtype=np.int64)),))


def digests(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Replace ``text`` by COLUMNS: the encoding's size and checksum (ids as little-endian unsigned 32-bit
    numbers), and what decoding gives back. ``round_trip``: it is the text, with U+2581 read as a space.

    Repeated rows give repeated results, columns of these names are replaced, others
    kept, and an empty table stays empty.
    """

    def row(t: Transducer, x: str | None) -> tuple:
        x = x or ""
        ids = t.encode(x)
        back = t.decode(ids)
        low, high = min(t.byte_ids.values(), default=0), max(t.byte_ids.values(), default=-1)
        n_bytes = int(((ids >= low) & (ids <= high)).sum())
        return len(ids), n_bytes, zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == x.replace(SPACE, " ")

    return _over_texts(df, model, text, COLUMNS, row)
