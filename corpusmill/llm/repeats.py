"""Operator 2: bytes that lie in a string of 400 bytes found elsewhere, by prefix-free parsing.

A rolling hash of eight bytes picks the triggers: a window of the text starts at a byte, and its
trigger is the smallest hash value among its first 128 positions. Windows in a row with one trigger form a
phrase. Equal windows have equal triggers at equal places, so they lie in phrases that agree
from the trigger on, in the ``core`` that all windows of a trigger hold.

Phrases with their context are the dictionary. They are brought into an order by (core, phrase), which
puts equal ones side by side: the order of the parse. A phrase that stands twice proves all
its windows at once, and one whose core stands once has none. Only where the two orders disagree, at the ends of
repeated passages, are single windows ordered. Orders are by 64-bit fingerprints in place
of letters: nothing but equality over 400 bytes is asked, and they spread evenly over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .spans import Joined, groups, mixed, released

GRAM = 8  # bytes of the rolling hash
REACH = 128  # positions among which a window's trigger is chosen; a power of two
FIGURES = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
PROVEN, PROXY, OPEN = 1, 2, 3  # windows all repeat; the same, and they are listed for others; to be listed


class Phrases(NamedTuple):
    first: np.ndarray  # first and last start of the windows
    last: np.ndarray
    core: np.ndarray  # fingerprints
    whole: np.ndarray


def phrases(texts: Joined, size: int) -> Phrases:
    data, none = texts.bytes, np.zeros(0, dtype=np.int64)
    long = texts.ends - texts.starts >= size
    if not long.any():
        return Phrases(none, none, none.astype(np.uint64), none.astype(np.uint64))
    eights = np.ndarray(len(data) - GRAM + 1, dtype="<u8", buffer=data, strides=(1,))
    places = np.arange(len(eights), dtype=np.uint64)
    least = ((eights * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - places)
    step = 1
    while step < REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    trigger = np.int64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(trigger) + 1, dtype=np.int8)
    edge[texts.starts[long]] += 1
    edge[texts.ends[long] - size + 1] -= 1
    valid = np.cumsum(edge[:-1]).astype(bool)
    same = (trigger[1:] == trigger[:-1]) & valid[1:] & valid[:-1]
    first = np.flatnonzero(valid & np.concatenate(([True], ~same)))
    last = np.flatnonzero(valid & np.concatenate((~same, [True])))
    at = trigger[first]
    core = texts.hashes(at, at + size - REACH + 1)
    return Phrases(first, last, core, texts.hashes(first, last + size))


def unique(keys: np.ndarray, many: np.ndarray | None = None) -> np.ndarray:
    """Distinct keys without their lowest bit, which then tells whether a key stands twice here."""
    flagged = (keys & ~np.uint64(1)) | (np.uint64(0) if many is None else many.astype(np.uint64))
    flagged.sort()
    base = flagged & ~np.uint64(1)
    start = np.flatnonzero(np.concatenate(([True], base[1:] != base[:-1]))) if len(base) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(start, len(base)))
    ends = np.append(start[1:], len(base)) - 1
    return base[start] | ((count > 1) | (flagged[ends] & np.uint64(1) == 1)).astype(np.uint64) if len(start) else base


# --- blocks: some texts in one row -----------------------------------------------------------


def blocks(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Written rows of about a megabyte of text, or one longer text: block, rows, sizes, packed."""
    ship_package(docs.sparkSession)
    headed = docs.select(F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("head"), F.col(text).alias("text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch["text"]]
            heads = batch["head"].tolist()
            for lo, hi in groups([len(t) for t in raw], 1 << 20):
                packed = zstandard.compress(b"".join(raw[lo:hi]), 3)
                yield pd.DataFrame({"heads": [heads[lo:hi]], "sizes": [[len(t) for t in raw[lo:hi]]], "packed": [packed]})

    made = headed.mapInPandas(released(rows), "heads array<string>, sizes array<bigint>, packed binary")
    return materialize(made.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


def texts_of(sizes, packed: bytes) -> Iterator[Joined]:
    """The texts of a block, a few at a time."""
    data = zstandard.decompress(packed)
    ends = np.cumsum(sizes)
    raw = [data[e - s : e] for e, s in zip(ends.tolist(), np.asarray(sizes).tolist())]
    for lo, hi in groups(np.asarray(sizes).tolist()):
        yield Joined(raw[lo:hi])


def dealt(block: int, parts: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[dict]:
    """Rows of packed columns, one for each part of the keys' range that occurs."""
    part = (key >> np.uint64(40)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, dtype=np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(part))):
        chosen = order[lo:hi]
        yield {"part": int(part[lo]), "block": block} | {f"c{k}": c[chosen].tobytes() for k, c in enumerate(columns)}


def framed(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def joined(group: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column and the place of the row each is from."""
    arrays = [np.frombuffer(x, dtype="<u8") for x in group[column]]
    return np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])


# --- the three passes ------------------------------------------------------------------------


def list_phrases(table: DataFrame, size: int, parts: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, sizes, packed in zip(batch["block"], batch["sizes"], batch["packed"]):
                found = [phrases(texts, size) for texts in texts_of(sizes, packed)]
                whole, core = (np.concatenate(c) for c in zip(*[(x.whole & ~np.uint64(1), x.core) for x in found]))
                order = np.argsort(whole, kind="stable")
                whole, core = whole[order], core[order]
                start = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1]))) if len(whole) else np.zeros(0, np.int64)
                many = np.diff(np.append(start, len(whole))) > 1
                whole = whole[start] | many.astype(np.uint64)
                yield framed(list(dealt(block, parts, core[start], core[start], whole)), ["part", "block", "c0", "c1"])

    return table.select("block", "sizes", "packed").mapInPandas(released(rows), "part bigint, block bigint, c0 binary, c1 binary")


def judge_phrases(group: pd.DataFrame) -> pd.DataFrame:
    """What each block has to do about its phrases whose core stands twice: phrase and code."""
    core, row = joined(group, "c0")
    flagged, _ = joined(group, "c1")
    whole, many = flagged & ~np.uint64(1), (flagged & np.uint64(1)).astype(np.int64)
    order = np.lexsort((whole, core))
    core, whole, many, row = core[order], whole[order], many[order], row[order]
    new_core = np.concatenate(([True], core[1:] != core[:-1]))
    new_whole = new_core | np.concatenate(([True], whole[1:] != whole[:-1]))
    core_at, whole_at = np.cumsum(new_core) - 1, np.cumsum(new_whole) - 1
    times = np.bincount(whole_at, weights=1 + many)[whole_at] > 1
    in_core = np.bincount(core_at, weights=1 + many)[core_at] > 1
    disputed = np.bincount(core_at, weights=~times)[core_at] > 0
    code = np.where(~in_core, 0, np.where(~times, OPEN, np.where(disputed & new_whole, PROXY, PROVEN)))
    return replies(group, row, code > 0, whole, code.astype(np.uint64))


def replies(group: pd.DataFrame, row: np.ndarray, chosen: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """Packed columns of the chosen entries, one row for each block."""
    at = np.flatnonzero(chosen)
    at = at[np.argsort(row[at], kind="stable")]
    blocks_of = group["block"].to_numpy()
    cuts = np.flatnonzero(np.concatenate(([True], row[at][1:] != row[at][:-1]))) if len(at) else np.zeros(0, np.int64)
    out = [
        {"block": int(blocks_of[row[at[lo]]])} | {f"c{k}": c[at[lo:hi]].tobytes() for k, c in enumerate(columns)}
        for lo, hi in zip(cuts, np.append(cuts[1:], len(at)))
    ]
    return pd.DataFrame(out, columns=["block", *[f"c{k}" for k in range(len(columns))]])


def codes_of(found: Phrases, names: list[bytes], codes: list[bytes]) -> np.ndarray:
    """The code of each phrase from the replies to its block."""
    name = np.concatenate([np.zeros(0, "<u8"), *[np.frombuffer(x, "<u8") for x in names]])
    code = np.concatenate([np.zeros(0, "<u8"), *[np.frombuffer(x, "<u8") for x in codes]])
    out = np.zeros(len(found.whole), dtype=np.int64)
    if len(name) and len(out):
        order = np.argsort(name)
        name, code = name[order], code[order]
        key = found.whole & ~np.uint64(1)
        place = np.minimum(np.searchsorted(name, key), len(name) - 1)
        out = np.where(name[place] == key, code[place].astype(np.int64), 0)
    return out


def starts_of(found: Phrases, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of the chosen phrases, and the place of the phrase of each."""
    at = np.flatnonzero(chosen)
    counts = found.last[at] - found.first[at] + 1
    owner = np.repeat(at, counts)
    return found.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), owner


def list_windows(table: DataFrame, size: int, parts: int) -> DataFrame:
    """Windows of phrases that are open or stand in for equal ones."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, sizes, packed, names, codes in zip(batch["block"], batch["sizes"], batch["packed"], batch["c0"], batch["c1"]):
                if names is None:
                    continue
                listed = []
                for texts in texts_of(sizes, packed):
                    found = phrases(texts, size)
                    code = codes_of(found, names, codes)
                    start, owner = starts_of(found, code >= PROXY)
                    listed.append((texts.hashes(start, start + size), code[owner] == PROXY))
                keys = unique(*(np.concatenate(c) for c in zip(*listed)))
                yield framed(list(dealt(block, parts, keys, keys)), ["part", "block", "c0"])

    return table.mapInPandas(released(rows), "part bigint, block bigint, c0 binary")


def judge_windows(group: pd.DataFrame) -> pd.DataFrame:
    flagged, row = joined(group, "c0")
    key, many = flagged & ~np.uint64(1), (flagged & np.uint64(1)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, many, row = key[order], many[order], row[order]
    place = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
    return replies(group, row, np.bincount(place, weights=1 + many)[place] > 1, key)


def covered(texts: Joined, size: int, names, codes, windows, words: int = 0) -> np.ndarray:
    """Which bytes of the joined texts lie in a repeated window, in runs with at least ``words`` beginnings of words."""
    edge = np.zeros(len(texts.bytes) + 1, dtype=np.int32)
    if names is not None:
        found = phrases(texts, size)
        code = codes_of(found, names, codes)
        sure = (code == PROVEN) | (code == PROXY)
        np.add.at(edge, found.first[sure], 1)
        np.add.at(edge, found.last[sure] + size, -1)
        if windows is not None:
            start, _ = starts_of(found, code == OPEN)
            known = np.concatenate([np.frombuffer(x, "<u8") for x in windows])
            start = start[np.isin(texts.hashes(start, start + size) & ~np.uint64(1), known)]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + size, -1)
    gone = np.cumsum(edge[:-1]) > 0
    if words and gone.any():
        first, last = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).reshape(-1, 2).T
        starts = texts.words()[0]
        enough = np.searchsorted(starts, last) - np.searchsorted(starts, first) >= words
        gone = kept_runs(len(gone), first[enough], last[enough])
    return gone


def kept_runs(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A mask of the given runs, which lie apart."""
    edge = np.zeros(n + 1, dtype=np.int8)
    edge[first], edge[last] = 1, -1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def answered(pairs: DataFrame, judge, columns: int, name: str) -> DataFrame:
    """Order each part, and gather the replies by block into lists; written."""
    schema = "block bigint, " + ", ".join(f"c{k} binary" for k in range(columns))
    found = pairs.groupBy("part").applyInPandas(judge, schema)
    return materialize(found.groupBy("block").agg(*[F.collect_list(f"c{k}").alias(f"c{k}") for k in range(columns)]), name)


def removed(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = 400, texts: bool = False, words: int = 0
) -> DataFrame:
    """The columns ``keep`` of each row and FIGURES, or with ``texts`` the text of the remaining bytes.

    A byte is removed if a string of ``size`` bytes around it also starts anywhere else in the input, in
    the same text or another, overlaps included; strings never cross texts. Null counts as
    empty, texts shorter than ``size`` lose nothing, a repeated row loses all its bytes if it is
    long enough. Runs of such bytes in which fewer than ``words`` words begin stay. With ``texts``, bytes of a
    character that was cut are left out as well. An empty table stays empty.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    table = blocks(docs, text, keep)
    parts = max(64, table.count() // 4)
    codes = answered(list_phrases(table, size, parts), judge_phrases, 2, "phrases")
    windows = list_windows(table.select("block", "sizes", "packed").join(codes, "block"), size, parts)
    repeated = answered(windows, judge_windows, 1, "windows").withColumnRenamed("c0", "windows")
    whole = table.join(codes, "block", "left").join(repeated, "block", "left")
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                heads = iter(r.heads)
                for few in texts_of(r.sizes, r.packed):
                    gone = covered(few, size, r.c0, r.c1, r.windows, words)
                    out = pd.DataFrame({"head": list(islice(heads, len(few.ends)))})
                    left = [few.bytes[s:e][~gone[s:e]].tobytes() for s, e in zip(few.starts, few.ends)]
                    if texts:
                        out["kept"] = [x.decode("utf-8", "ignore") for x in left]
                    else:
                        total = np.concatenate(([0], np.cumsum(gone)))
                        rises = np.concatenate(([0], np.cumsum(gone & ~np.concatenate(([False], gone[:-1])))))
                        out["n_bytes"] = few.ends - few.starts
                        out["n_removed"] = total[few.ends] - total[few.starts]
                        out["n_spans"] = rises[few.ends] - rises[few.starts]
                        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in left]
                    yield out

    found = whole.mapInPandas(released(rows), "head string, " + ("kept string" if texts else FIGURES))
    head = F.from_json("head", docs.select(*keep).schema)
    named = [F.col("kept").alias(text)] if texts else [F.col(c.split()[0]) for c in FIGURES.split(", ")]
    return found.withColumn("head", head).select("head.*", *named)
