"""Operator 1: documents packed into sequences, planned as a cutting-stock problem.

A document gives whole sequences and one shorter rest. Rests are counted by length class; that
histogram has a few hundred rows whatever the corpus, so its linear program is solved on the
driver. The rounded patterns say which ranks of each class share a sequence, and every rest finds its
place from its rank alone.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .lp import whole_plan
from .spans import groups, released

PIECES = (
    "row_id bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)


END = "\0"  # stands for the end of a word; texts that hold it go to tokenizers
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANK, LETTER, NUMBER, OTHER = range(4)
APOSTROPHE = ord("'")


class Encoder:
    """Token ids of texts for a lower-casing byte-level BPE with word ends, as its JSON file defines it.

    The texts of a call are cut into words at once, over the array of their code points, and every distinct
    word is encoded once, all of them by one call of tiktoken with the file's vocabulary as ranks: its
    ids are in the order of its merges. It gives the ids that ``tokenizers`` gives, many times as
    fast; files of another make, and parts that hold a special token or ``END``, are left to ``tokenizers``.
    """

    def __init__(self, spec: str):
        self.spec = spec
        parsed = json.loads(spec)
        model = parsed["model"]
        self.special = [t["content"] for t in parsed["added_tokens"]]
        steps = [n["type"] for n in (parsed["normalizer"] or {}).get("normalizers", [])]
        splits = (parsed["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.fast = (
            steps == ["NFC", "Replace", "Lowercase"]
            and splits[0].get("type") == "Split"
            and splits[0]["pattern"].get("Regex") == WORDS
            and model["end_of_word_suffix"] == "</w>"
        )
        if self.fast:
            ranks = ranks_of(model["vocab"], set(self.special))
            self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.ends[[i for token, i in ranks.items() if len(token) > 1 and token.endswith(END.encode())]] = True

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def odd(self, text: str) -> bool:
        return not self.fast or END in text or any(s in text for s in self.special)

    def mixed(self, text: str) -> np.ndarray:
        """The ids of a text some of whose parts are odd."""
        runs = [(odd, " ".join(parts)) for odd, parts in groupby(split_plain(text), self.odd)]
        plain = iter(self.plain([run for odd, run in runs if not odd]))
        return np.concatenate([self.exact(run) if odd else next(plain) for odd, run in runs])

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that hold nothing odd."""
        # each letter is lowered by itself, so a last sigma is no exception
        lowered = [t.lower() if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        words, until = words_of(lowered)
        if not len(words):
            return [np.zeros(0, dtype="<u4") for _ in texts]
        found = words.dictionary_encode()
        ids, first = self.spelled(found.dictionary)
        which = found.indices.to_numpy()
        count = np.diff(first)[which]
        total = np.concatenate(([0], np.cumsum(count)))
        flat = ids[np.repeat(first[which] - total[:-1], count) + np.arange(total[-1])]
        return np.split(flat, total[until[:-1]])

    def spelled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and the place of the first of each word and behind the last."""
        ids = np.array(self.ranks.encode_ordinary(END.join([*words.to_numpy(zero_copy_only=False), ""])), dtype="<u4")
        return ids, np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.fast:
            return [self.exact(t) for t in texts]
        odd = [self.odd(t) for t in texts]
        found = self.plain(["" if o else t for t, o in zip(texts, odd)])
        return [self.mixed(t) if o else x for t, o, x in zip(texts, odd, found)]

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point, as the patterns of ``regex`` tell them."""
    if not _kinds:
        found = np.full(0x110000, OTHER, dtype=np.uint8)
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        at, every = np.array(points), "".join(map(chr, points))
        for kind, pattern in ((BLANK, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for run in regex.finditer(pattern, every):
                found[at[run.start() : run.end()]] = kind
        _kinds.append(found)
    return _kinds[0]


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """What ``WORDS`` matches in the lower-case texts, in order, and the number of words up to the end of each text."""
    whole = "\n".join([*texts, ""])
    data = whole.encode()
    codes = np.frombuffer(data if whole.isascii() else whole.encode("utf-32-le"), dtype=np.uint8 if whole.isascii() else "<u4")
    kind = kinds()[codes]
    begins = np.ones(len(codes), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == NUMBER
    # a lone apostrophe takes one of s, t, m, d or re, ve, ll from the letters behind it; the last code is a line break
    lone = np.flatnonzero(codes == APOSTROPHE)
    lone = lone[begins[lone] & (kind[lone + 1] == LETTER)]
    one, two = codes[lone + 1], codes[np.minimum(lone + 2, len(codes) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    pair = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
    begins[lone[short | pair] + 1] = False
    for taken, n in ((short, 2), (pair, 3)):
        begins[lone[taken] + n] = True
    starts = np.flatnonzero(begins)
    chosen = kind[starts] != BLANK
    places = np.append(starts, len(codes))
    if len(data) > len(codes):
        width = np.ones(len(codes), dtype=np.uint8)
        for bound in (0x80, 0x800, 0x10000):
            width += codes >= bound
        places = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[places]
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return runs.filter(pa.array(chosen)), np.searchsorted(starts[chosen], ends)


def ranks_of(vocab: dict[str, int], special: set[str]) -> dict[bytes, int]:
    """The vocabulary in bytes: printable characters stand for themselves, others were moved past 255."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {}
    for token, rank in vocab.items():
        if token not in special:
            core = token.removesuffix("</w>")
            ranks[bytes(byte_of[c] for c in core) + (END.encode() if core != token else b"")] = rank
    return ranks


_ready: dict[str, Encoder] = {}


def encoder_of(spec: str) -> Encoder:
    """One for each worker process, so that the file is read once."""
    if spec not in _ready:
        _ready.clear()
        _ready[spec] = Encoder(spec)
    return _ready[spec]


def split_plain(text: str) -> list[str]:
    """Parts between ASCII spaces and line marks, which every definition of white space holds."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if text else []


def encoded(docs: DataFrame, spec: str, last_id: int, size: int) -> DataFrame:
    """The ids of each row, cut into pieces of ``size`` and a rest; written to the shared folder."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # the tokenizer's file, 2 MB

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            lengths = batch["text"].str.len().fillna(0).astype(int).tolist()
            for lo, hi in groups(lengths, 1 << 20):
                some = batch.iloc[lo:hi]
                ids = [np.append(x, np.uint32(last_id)).astype("<u4") for x in encoder.many([t or "" for t in some["text"]])]
                cuts = [range(0, len(x), size) for x in ids]
                count = [len(c) for c in cuts]
                yield pd.DataFrame(
                    {
                        "row_id": np.repeat(some["row_id"].to_numpy(), count),
                        "doc_id": some["doc_id"].repeat(count).array,
                        "doc_tokens": np.repeat([len(x) for x in ids], count),
                        "start": np.concatenate([np.array(c) for c in cuts]),
                        "length": [min(size, len(x) - i) for x, c in zip(ids, cuts) for i in c],
                        "ids": [x[i : i + size].tobytes() for x, c in zip(ids, cuts) for i in c],
                    }
                )

    # an id per row, so that repeated documents stay apart; it is written with the row
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    schema = "row_id bigint, doc_id bigint, doc_tokens bigint, start bigint, length bigint, ids binary"
    return materialize(numbered.mapInPandas(released(rows), schema), "encoded")


def classes(size: int, exact: int = 64) -> np.ndarray:
    """Upper bounds of the length classes: every length up to ``exact``, then steps of length / ``exact``."""
    bounds, step, at = [], 1, 0
    while at < size:
        at = min(at + step, size)
        bounds.append(at)
        if at >= 2 * exact * step:
            step *= 2
    return np.array(bounds, dtype=np.int64)


class Plan(NamedTuple):
    """For each class the first rank of each of its slots, with pattern, copies per sequence and first sequence."""

    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int


def plan(counts: dict[int, int], bounds: np.ndarray, size: int) -> Plan:
    """``counts``: rests per class."""
    kinds = np.array(sorted(counts), dtype=np.int64)
    if not len(kinds):
        return Plan({}, 0)
    found = whole_plan(bounds[kinds], np.array([counts[int(k)] for k in kinds], dtype=np.int64), size)
    slots: dict[int, list[tuple[int, int, int, int]]] = {int(k): [] for k in kinds}
    given = np.zeros(len(kinds), dtype=np.int64)
    sequence = 0
    for number, (pattern, times) in enumerate(found):
        for i in np.flatnonzero(pattern):
            slots[int(kinds[i])].append((int(given[i]), number, int(pattern[i]), sequence))
            given[i] += pattern[i] * times
        sequence += times
    return Plan({k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in slots.items() if v}, sequence)


def ranked(rests: DataFrame) -> DataFrame:
    """Number the rests of each class 0, 1, ...; a class with a third of all rows is numbered in many parts."""
    parts = max(1, int(rests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rests.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int"))
    counts = salted.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    # as many rows per class as there are salts
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("class", "salt").orderBy("row_id")
    return (
        salted.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["class", "salt"])
        .withColumn("rank", F.col("rank") + F.col("offset"))
        .drop("salt", "offset")
    )


def placed(rests: DataFrame, found: Plan) -> DataFrame:
    """Sequence and place within it of each rest, looked up by class and rank."""
    shared = rests.sparkSession.sparkContext.broadcast(found)  # a few thousand slots at most

    def place(kind: pd.Series, rank: pd.Series) -> pd.DataFrame:
        kinds, ranks = kind.to_numpy(), rank.to_numpy()
        sequence, order = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        for k in np.unique(kinds):
            at = np.flatnonzero(kinds == k)
            firsts, _, copies, base = shared.value.slots[int(k)]
            slot = np.searchsorted(firsts, ranks[at], side="right") - 1
            within = ranks[at] - firsts[slot]
            sequence[at] = base[slot] + within // copies[slot]
            order[at] = k * 4096 + within % copies[slot]
        return pd.DataFrame({"sequence_id": sequence, "order": order})

    apply = F.pandas_udf(place, "sequence_id bigint, order bigint")
    return rests.withColumn("__p", apply("class", "rank")).select(*rests.columns, "__p.sequence_id", "__p.order")


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """Give the rows, of which ``i`` counts those of one row_id, sequences from ``first`` on."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_id", "i"), F.lit(parts)).cast("int"))
    counts = salted.groupBy("salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row per salt
    offsets = counts.select("salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("salt").orderBy("row_id", "i")
    return (
        salted.withColumn("n", F.row_number().over(within) - 1)
        .join(offsets, "salt")
        .withColumn("sequence_id", F.col("n") + F.col("before") + first)
        .drop("salt", "n", "before")
    )


def pack(docs: DataFrame, spec: str, size: int = 2048, last_id: int = 1) -> DataFrame:
    """Pieces of PIECES: which ids of which row lie where, and the ids themselves, little-endian in 4 bytes each.

    ``docs`` has doc_id and text, ``spec`` is the tokenizer's JSON. Null and empty texts are the closing id
    alone. A document of more than ``size`` ids is cut at multiples of it, every other one stays whole. Rows
    that repeat are packed each, ties of length are ordered by row; other columns are ignored, an
    empty table has no pieces. Sequences are numbered from 0, offsets within one have no gap.
    """
    table = encoded(docs, spec, last_id, size)
    lengths = table.drop("ids")
    bounds = classes(size)
    class_of = F.pandas_udf(lambda x: pd.Series(np.searchsorted(bounds, x.to_numpy())), "bigint")
    rests = lengths.where(F.col("length") < size).withColumn("class", class_of("length"))
    counts = {r["class"]: r["n"] for r in rests.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per class
    found = plan(counts, bounds, size)
    order = Window.partitionBy("sequence_id").orderBy("order")
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    shared = placed(ranked(rests), found).withColumn("offset", F.coalesce(offset, F.lit(0))).drop("class", "rank", "order")
    full = numbered(lengths.where(F.col("length") == size).withColumn("i", F.col("start")), found.sequences)
    full = full.withColumn("offset", F.lit(0).cast("bigint"))
    places = ["row_id", "start", "sequence_id", "offset"]
    # ids are exchanged once, when all places are known
    pieces = table.join(shared.select(*places).unionByName(full.select(*places)), ["row_id", "start"])
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(*[c.split()[0] for c in PIECES.split(", ")])


def sequences(pieces: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """Training sequences of exactly ``size`` ids, little-endian in 4 bytes: sequence_id, ids, and the lengths of its pieces.

    What follows the last piece is filled with ``pad_id``.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(bytearray()), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.rpad(joined, F.lit(4 * size), F.lit(bytearray(pad_id.to_bytes(4, "little")))).alias("ids"),
        F.col("parts.length").alias("lengths"),
    )
