"""Operator 4: URL rules as one bit-parallel wildcard automaton.

All rules are packed, bit by bit, into masks of 64-bit words. One Shift-And step per byte
moves every rule of every URL of a batch at once.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package


class Rule(NamedTuple):
    """``host`` fits itself and its subdomains, ``path`` is a prefix; ``*`` stands for any run of bytes
    (of one without a slash in the host)."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Automaton:
    """Bit ``i`` of a rule is set while its first ``i`` bytes have been read."""

    def __init__(self, rules: Sequence[Rule]):
        steps: list[tuple[int, bool, bool]] = []  # the byte that sets a bit, and whether it stays: before, after the host
        self.firsts, self.lasts = [], []
        for rule in rules:
            self.firsts.append(len(steps))
            steps.append((-1, True, False))  # any labels before the host, but no slash
            for part, inside in (("." + rule.host, True), (rule.path, False)):
                for byte in part.encode():
                    if byte == ord("*"):
                        code, *_ = steps[-1]
                        steps[-1] = (code, True, not inside)
                    else:
                        steps.append((byte, False, False))
            code, *_ = steps[-1]
            steps[-1] = (code, True, True)
            self.lasts.append(len(steps) - 1)
        words = max(1, -(-len(steps) // 64))
        self.enter = np.zeros((256, words), dtype=np.uint64)
        self.stay = np.zeros((256, words), dtype=np.uint64)
        for i, (code, same, always) in enumerate(steps):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if code >= 0:
                self.enter[code, word] |= bit
            if same:
                self.stay[:, word] |= bit
                if not always:
                    self.stay[ord("/"), word] &= ~bit
        self.start = self._mask(self.firsts, words)
        self.final = self._mask(self.lasts, words)

    @staticmethod
    def _mask(bits: Sequence[int], words: int) -> np.ndarray:
        mask = np.zeros(words, dtype=np.uint64)
        for i in bits:
            mask[i // 64] |= np.uint64(1 << (i % 64))
        return mask

    def states(self, texts: Sequence[bytes]) -> np.ndarray:
        """The masks after each text; a text whose live bits are all final ones is left early."""
        masks = np.repeat(self.start[None], len(texts), axis=0)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        offsets = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        live, step = np.flatnonzero(lengths), 0
        while live.size:
            byte = data[offsets[live] + step]
            now = masks[live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            now = (moved & self.enter[byte]) | (now & self.stay[byte])
            masks[live] = now
            step += 1
            live = live[(lengths[live] > step) & (now & ~self.final).any(axis=1)]
        return masks

    def fits(self, masks: np.ndarray, rule: int) -> np.ndarray:
        bit = self.lasts[rule]
        return (masks[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1


def canonical(url: Column) -> tuple[Column, Column]:
    """Host, ASCII lower case, and path; both empty for a null or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, pattern, 2)


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to each row.

    The longest rule wins, of equally long ones the first. Columns of those four names are
    replaced. Null, empty and malformed URLs get the default; very long ones are read to the end
    unless no rule can fit any more. Repeated rows are judged alike, an empty table stays empty.
    """
    ship_package(df.sparkSession)
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))
    rules = [rules[i] for i in order]
    automaton = Automaton(rules)
    names = np.array([r.name for r in rules] + [None], dtype=object)
    verdicts = np.array([r.verdict for r in rules] + [default], dtype=object)

    def apply(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        masks = automaton.states([f".{h}{p}".encode() for h, p in zip(hosts, paths)])
        best = np.full(len(masks), len(rules))
        for i in reversed(range(len(rules))):
            best[automaton.fits(masks, i)] = i
        return pd.DataFrame({"rule": names[best], "verdict": verdicts[best]})

    matched = F.pandas_udf(apply, "rule string, verdict string")
    host, path = canonical(F.col(url))
    plain = df.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    return (
        plain.withColumns({"host": host, "path": path})
        .withColumn("__judged", matched("host", "path"))
        .withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")})
        .drop("__judged")
    )
