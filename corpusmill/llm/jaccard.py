"""Operator 3: pairs of texts whose sets of five-word shingles are similar, by a MinHash LSH forest.

Each tree of the forest gives a text a path of minhashes, of two bytes each. Sorted, the paths of all texts are a trie: texts
with the first d minhashes alike share its node at depth d, and texts that share one in any tree meet and are verified with their
whole sets. At first paths are taken at their full depth. The verified links say how similar linked texts are, and so what share of
all links a depth lets meet: each link found stands for as many as its chance to be found is small. While
that share is below the target, the paths are shortened to the deepest depth that reaches it, and the texts that
share a node there are verified.

Texts with the same words are one class and are compared once. Classes that meet are put into blocks of
some 256, and a task compares two blocks, so a bucket with thousands of near copies is many small
tasks, and what leaves a task is a count for each class and one link of it, not the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .components import components
from .spans import Joined, groups, mixed, released, shingles

TREES, DEEPEST = 24, 8
BLOCK = 256


def recall(threshold: float, depth: int, trees: int = TREES) -> float:
    """Chance that texts of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def shortened(found: np.ndarray, depth: int, threshold: float, target: float) -> int:
    """The deepest depth, ``depth`` at most, whose share of all links reaches the target.

    ``found`` holds, over the links verified at ``depth``, the sums of recall(d) / recall(depth) for d = 1 … DEEPEST, and of
    1 / recall(depth). A link at the threshold is added, so few links do not end the search early.
    """
    chances = np.array([recall(threshold, d) for d in range(1, DEEPEST + 1)])
    sums = found + np.append(chances, 1.0) / recall(threshold, depth)
    for d in range(depth, 1, -1):
        if sums[d - 1] >= target * sums[-1]:
            return d
    return 1


def shingle_sets(raw: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and text numbers of the shingles, both in order of the text.

    A text of fewer words, but one at least, is a single shingle of them all.
    """
    texts = Joined(raw)
    starts, ends, owner = texts.words()
    hashes = texts.hashes(starts, ends)
    found, whose = shingles(hashes, owner, size)
    count = np.bincount(owner, minlength=len(raw))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count) - count
        extra = np.array([int(mixed(np.array([sum(int(h) * (k + 3) for k, h in enumerate(hashes[first[i] : first[i] + count[i]])) % 2**64], dtype=np.uint64))[0]) for i in short], dtype=np.uint64)
        found, whose = np.concatenate((found, extra)), np.concatenate((whose, short))
        order = np.argsort(whose, kind="stable")
        found, whose = found[order], whose[order]
    return found, whose


def paths(found: np.ndarray, whose: np.ndarray, n: int) -> list[bytes | None]:
    """For each text its paths in all trees, one after the other; None without shingles."""
    out: list[bytes | None] = [None] * n
    if not len(found):
        return out
    starts = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
    random = np.random.default_rng(8).integers(1, 2**63, (TREES * DEEPEST, 2), dtype=np.uint64)
    steps = np.zeros((len(starts), TREES * DEEPEST), dtype=">u2")
    for k, (mask, factor) in enumerate(random):
        least = np.minimum.reduceat((found ^ mask) * (factor | np.uint64(1)), starts)
        steps[:, k] = mixed(least) >> np.uint64(48)
    for row, i in zip(steps, whose[starts].tolist()):
        out[i] = row.tobytes()
    return out


def nodes(path: Column, depth: int) -> Column:
    """The trie node at this depth in every tree: a number of tree and prefix."""
    step = 2 * DEEPEST
    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(path, t * step + 1, F.lit(2 * depth))))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per row: id, words (a digest of the word sequence), path; written."""
    ship_package(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch["text"]]
            found_paths: list[bytes | None] = []
            for lo, hi in groups([len(t) for t in raw]):
                found, whose = shingle_sets(raw[lo:hi], size)
                found_paths += paths(found, whose, hi - lo)
            words = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in raw]
            yield pd.DataFrame({"id": batch["doc_id"], "words": words, "path": found_paths})

    schema = "id bigint, words binary, path binary"
    return materialize(docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(released(rows), schema), "signatures")


def blocked(classes: DataFrame) -> DataFrame:
    """Classes that meet others: class_id, prefixes, their block ``home`` and the pairs of blocks it is compared in."""
    each = classes.select("class_id", F.explode("prefixes").alias("prefix"))
    shared = each.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("lead")).where("n > 1").drop("n")
    members = materialize(each.join(shared, "prefix"), "members")
    # classes that meet, directly or through others, share blocks; small groups of them lie in one
    groups_of = components(members.select(F.col("class_id").alias("a"), F.col("lead").alias("b")))
    groups_of = materialize(groups_of.withColumnRenamed("id", "class_id"), "groups")
    sizes = groups_of.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    few = max(1, -(-groups_of.count() // BLOCK))
    small = F.xxhash64(F.lit(0), F.pmod(F.xxhash64("root"), F.lit(few)))
    part = F.xxhash64("root", F.pmod(F.xxhash64("class_id"), F.ceil(F.col("n") / BLOCK)))
    homes = groups_of.join(sizes, "root").select("class_id", F.when(F.col("n") < BLOCK, small).otherwise(part).alias("home"))
    homes = materialize(homes, "homes")
    seen = members.join(homes, "class_id").select("prefix", F.col("home").alias("block")).distinct()
    other = seen.withColumnRenamed("block", "other")
    pairs = seen.join(other, "prefix").where("block <= other").select("block", "other").distinct()
    ends = pairs.withColumn("home", F.explode(F.array_distinct(F.array("block", "other"))))
    lists = ends.groupBy("home").agg(F.collect_list(F.struct("block", "other")).alias("pairs"))
    return homes.join(lists, "home").join(classes, "class_id")


def verify(group: pd.DataFrame, threshold: float, one: bool, depth: int) -> pd.DataFrame:
    """Links between two blocks, or within one: per class their number and the least class it is linked to this way.

    A row without class holds the sums over the links that ``shortened`` asks for.
    """
    ids = group["class_id"].to_numpy()
    keys = np.array(group["prefixes"].tolist(), dtype=np.int64)
    sets = [np.frombuffer(x, dtype="<u8") for x in group["shingles"]]
    side = group["home"].to_numpy() == group["block"].to_numpy()
    a, b = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(side), np.flatnonzero(~side))
    met = np.zeros((len(a), len(b)), dtype=bool)
    for tree in range(keys.shape[1]):
        met |= keys[a, tree][:, None] == keys[b, tree][None]
    if one:
        met = np.triu(met, 1)
    i, j = np.nonzero(met)
    sizes = np.array([len(s) for s in sets])
    common = overlaps(sets, a, b)
    union = sizes[a][:, None] + sizes[b][None] - common
    linked = common[i, j] >= threshold * union[i, j] - 1e-9
    alike = common[i[linked], j[linked]] / union[i[linked], j[linked]]
    chances = np.append([recall(alike, d) for d in range(1, DEEPEST + 1)], [np.ones(len(alike))], axis=0)
    sums = (chances / chances[depth - 1]).sum(axis=1)
    i, j = a[i[linked]], b[j[linked]]
    count = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    root = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(ids))
    root = rank.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = np.minimum(low, low[order[low]])
        if (low == root).all():
            break
        root = low
    some = np.flatnonzero(count)
    out = pd.DataFrame({"class_id": ids[some], "n_links": count[some], "root": ids[order[root[some]]], "sums": None}, dtype=object)
    out.loc[len(out)] = [None, None, None, sums]
    return out


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets ``a`` with the sets ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    wide = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    owner, column = owner[keep], wide[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(wide[-1]) + 1 if len(wide) else 0, width):
        s, e = np.searchsorted(column, (lo, lo + width))
        table = np.zeros((len(sets), width), dtype=np.float32)
        table[owner[s:e], column[s:e] - lo] = 1
        out += table[a] @ table[b].T
    return out.astype(np.int64)


def compared(docs: DataFrame, classes: DataFrame, depth: int, size: int, threshold: float) -> DataFrame:
    """What ``verify`` says of all blocks of classes that share a node at this depth."""
    needed = blocked(classes.where("path IS NOT NULL").select("class_id", nodes(F.col("path"), depth).alias("prefixes")))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch["text"]]
            packed: list[bytes] = []
            for lo, hi in groups([len(t) for t in raw]):
                found, whose = shingle_sets(raw[lo:hi], size)
                cuts = np.searchsorted(whose, np.arange(hi - lo + 1))
                packed += [np.unique(found[s:e]).tobytes() for s, e in zip(cuts, cuts[1:])]
            yield batch[["class_id", "home", "prefixes", "pairs"]].assign(shingles=packed)

    texts = docs.select(F.col("doc_id").alias("class_id"), "text").join(needed, "class_id")
    types = "class_id bigint, home bigint, prefixes array<bigint>, pairs array<struct<block:bigint,other:bigint>>, shingles binary"
    loaded = texts.mapInPandas(released(sets), types).select("class_id", "home", "prefixes", "shingles", F.inline("pairs"))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return verify(group.drop_duplicates("class_id"), threshold, key[0] == key[1], depth)

    schema = "class_id bigint, n_links bigint, root bigint, sums array<double>"
    return loaded.groupBy("block", "other").applyInPandas(compare, schema)


def similar(docs: DataFrame, size: int = 5, threshold: float = 0.8, target: float = 0.9999) -> DataFrame:
    """One row per document with an id: doc_id, class_id, n_links, component_id, kept.

    Words are runs of other characters than ASCII white space. Documents with the same words are a class,
    named by its smallest doc_id; ``n_links`` counts the other classes of a similarity of ``threshold`` or more,
    ``component_id`` is the smallest doc_id reachable by links, ``kept`` is true where it is the own one.
    Null and empty texts are one class without links, texts of fewer than ``size`` words are one shingle.
    Rows without doc_id are left out, repeated rows are repeated, other columns are ignored,
    an empty table gives an empty one.
    """
    marked = signatures(docs, size)
    classes = marked.groupBy("words").agg(F.min("id").alias("class_id"), F.first("path").alias("path"))
    classes = materialize(classes, "classes")
    depth, found = DEEPEST, None
    while True:
        found = materialize(compared(docs, classes, depth, size, threshold), "found")
        # one row to the driver
        totals = found.where("class_id IS NULL").agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0.0)) for k in range(DEEPEST + 1)]).first()
        shorter = shortened(np.array(totals), depth, threshold, target)
        if shorter == depth:
            break
        depth = shorter
    found = found.where("class_id IS NOT NULL")
    counts = found.groupBy("class_id").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "class_id")
    named = classes.select("words", "class_id").join(counts, "class_id", "left").join(roots, "class_id", "left")
    return marked.select(F.col("id").alias("doc_id"), "words").join(named, "words").select(
        "doc_id",
        "class_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "class_id").alias("component_id"),
        (F.coalesce("root", "class_id") == F.col("doc_id")).alias("kept"),
    )
