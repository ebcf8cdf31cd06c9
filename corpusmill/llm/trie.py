"""Operator 12: the prefix trie of conversations, rolled up by centroid decomposition.

A node is the set of conversations that begin alike. It is named by its smallest member and its depth, which
no other node shares. The digest of a prefix is the exclusive or of one digest per (place, turn), so
prefixes of all rows come from a running aggregate, cut into segments where a conversation is long.

Subtree totals are found on the forest of parent edges. A node's weight within its component is known at first: the number of
rows of its members from there on. While a component weighs more than ``BOUND``, Spark takes out the
centroids of all such components in one round, with joins on (conversation, depth). Smaller
components go to tasks whole, where ``centroid`` goes on in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .centroid import subtree_sums

BOUND = 100_000
SEGMENT = 4096
WORD = "[^\\x20\\x09-\\x0D]+"
NODE = ["conv_id", "depth"]
TOP = ["top_id", "top_depth"]


def steps(turns: DataFrame, segment: int) -> DataFrame:
    """``conv_id, depth, k1, k2, words``: the digest of the prefix that each turn ends."""
    written = F.concat(F.col("depth").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    half = lambda at: F.conv(F.substring("__md5", at, 16), 16, -10).cast("bigint")
    own = turns.withColumn("__md5", F.md5(written.cast("binary"))).select(
        *NODE, half(1).alias("o1"), half(17).alias("o2"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"),
        F.floor(F.col("depth") / segment).alias("segment"),
    )
    upto = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = own.select(*NODE, "segment", "words", F.bit_xor("o1").over(upto).alias("k1"), F.bit_xor("o2").over(upto).alias("k2"))
    long = own.where("segment > 0").select("conv_id").distinct()
    if long.isEmpty():
        return run.drop("segment")
    # one row per segment of a long conversation
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = own.join(long, "conv_id", "left_semi").groupBy("conv_id", "segment").agg(F.bit_xor("o1").alias("s1"), F.bit_xor("o2").alias("s2"))
    earlier = whole.select("conv_id", "segment", F.bit_xor("s1").over(before).alias("b1"), F.bit_xor("s2").over(before).alias("b2"))
    joined = run.join(earlier, ["conv_id", "segment"], "left")
    return joined.select(*NODE, "words", *[F.col(f"k{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))).alias(f"k{i}") for i in (1, 2)])


def paths(turns: DataFrame, lengths: DataFrame, segment: int) -> DataFrame:
    """Written: each conversation's node at each depth, ``conv_id, depth, node, up, n_convs, words, weight``.

    ``node`` and ``up`` are the smallest members of the node and of its parent.
    """
    root = lengths.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length") + 1).alias("weight")).first()
    rows = materialize(steps(turns, segment).join(lengths, "conv_id"), "steps")
    key = ["depth", "k1", "k2"]
    nodes = rows.groupBy(*key).agg(
        F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("n_words"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    # written, so that Spark can split the rows of a common beginning in the join
    nodes = materialize(nodes, "prefixes")
    found = materialize(rows.select("conv_id", *key).join(nodes, key).drop("k1", "k2"), "nodes")
    least = F.lit(root["least"]).cast(lengths.schema["conv_id"].dataType)
    top = lengths.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), least.alias("node"), F.lit(root["n"]).cast("bigint").alias("n_convs"),
        F.lit(0).cast("bigint").alias("n_words"), F.lit(root["weight"]).cast("bigint").alias("weight"),
    )
    above = found.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
    deep = found.join(above, NODE, "left").withColumn("up", F.when(F.col("depth") == 1, least).otherwise(F.col("up")))
    return materialize(deep.unionByName(top, allowMissingColumns=True), "paths")


# --- the rollup ---------------------------------------------------------------------------------


def split_round(state: DataFrame, path: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(centroids with their sums, what is left) of the components in ``heavy``, one centroid each."""
    active = state.join(heavy, TOP)
    centre = active.where("2 * weight > whole").groupBy(*TOP).agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c"))
    centre = materialize(
        centre.select(*TOP, F.col("c.conv_id").alias("c_id"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids"
    )
    # a node lies below the centroid if the way to it passes from the centroid to one of its children
    child = path.select(F.col("conv_id"), (F.col("depth") - 1).alias("c_depth"), F.col("node").alias("child"), F.col("up").alias("c_id"), F.lit(True).alias("passes"))
    placed = active.drop("whole").join(centre, TOP).join(child, ["conv_id", "c_depth", "c_id"], "left")
    is_centre = (F.col("conv_id") == F.col("c_id")) & (F.col("depth") == F.col("c_depth"))
    inner = F.coalesce(F.col("passes"), F.lit(False)) & (F.col("depth") > F.col("c_depth"))
    placed = materialize(placed.withColumns({"is_centre": is_centre, "inner": inner}), "placed")
    totals = materialize(
        placed.where("is_centre OR inner").groupBy("c_id", "c_depth").agg(F.sum("leaf").alias("t_leaves"), F.sum("saved").alias("t_saved")), "totals"
    )
    done = placed.where("is_centre").join(totals, ["c_id", "c_depth"]).select(
        *NODE, (F.col("add_leaves") + F.col("t_leaves")).alias("n_leaves"), (F.col("add_saved") + F.col("t_saved")).alias("saved_tokens")
    )
    # the way from each centroid to the top of its component
    way = path.select(F.col("conv_id").alias("c_id"), F.col("depth"), F.col("node").alias("conv_id"))
    way = centre.join(totals, ["c_id", "c_depth"]).join(way, "c_id").where("depth >= top_depth AND depth < c_depth")
    way = way.select(*NODE, "c_weight", "t_leaves", "t_saved")
    left = placed.where("NOT is_centre").drop("c_weight").join(way, NODE, "left")
    less = lambda c: F.coalesce(c, F.lit(0))
    return done, left.select(
        *NODE, "up", "leaf", "saved",
        F.when(F.col("inner"), F.col("child")).otherwise(F.col("top_id")).alias("top_id"),
        F.when(F.col("inner"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        (F.col("weight") - less("c_weight")).alias("weight"),
        (F.col("add_leaves") + less("t_leaves")).alias("add_leaves"),
        (F.col("add_saved") + less("t_saved")).alias("add_saved"),
    )


def rolled_here(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of whole components."""
    at = pd.MultiIndex.from_arrays([frame["conv_id"], frame["depth"]])
    up = at.get_indexer(pd.MultiIndex.from_arrays([frame["up"], frame["depth"] - 1]))
    is_top = (frame["conv_id"] == frame["top_id"]) & (frame["depth"] == frame["top_depth"])
    parent = np.where(is_top, -1, up)
    sums = subtree_sums(parent, frame["depth"].to_numpy(), frame[["leaf", "saved"]].to_numpy(dtype=np.int64))
    out = frame[NODE].copy()
    out["n_leaves"], out["saved_tokens"] = frame["add_leaves"] + sums[:, 0], frame["add_saved"] + sums[:, 1]
    return out


def rolled(state: DataFrame) -> DataFrame:
    """Sums of all components; a task reads them one after the other."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            frame = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            last = (frame["top_id"] == frame["top_id"].iloc[-1]) & (frame["top_depth"] == frame["top_depth"].iloc[-1])
            kept, whole = frame[last], frame[~last].reset_index(drop=True)
            if len(whole):
                yield rolled_here(whole)
        if kept is not None and len(kept):
            yield rolled_here(kept.reset_index(drop=True))

    ids = dict(state.dtypes)["conv_id"]
    placed = state.drop("weight").repartition(*TOP).sortWithinPartitions(*TOP)
    # a top has no parent in its component, and the root none at all
    placed = placed.withColumn("up", F.coalesce("up", "conv_id"))
    return placed.mapInPandas(rows, f"conv_id {ids}, depth bigint, n_leaves bigint, saved_tokens bigint")


def rollup(nodes: DataFrame, path: DataFrame, bound: int = BOUND) -> DataFrame:
    """``conv_id, depth, n_leaves, saved_tokens``: sums of ``leaf`` and ``saved`` over each node's subtree."""
    zero = F.lit(0).cast("bigint")
    root = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]  # one node
    top = F.lit(root).cast(nodes.schema["conv_id"].dataType).alias("top_id")
    state = nodes.select(*NODE, "up", "leaf", "saved", "weight", zero.alias("add_leaves"), zero.alias("add_saved"), top, zero.alias("top_depth"))
    small, sums = [], []
    while True:
        whole = state.groupBy(*TOP).agg(F.max("weight").alias("whole")).where(F.col("whole") > bound)
        heavy = materialize(whole, "heavy")
        if heavy.isEmpty():
            small.append(state)
            break
        small.append(state.join(heavy.select(*TOP), TOP, "left_anti"))
        done, left = split_round(state, path, heavy)
        sums.append(done)
        state = materialize(left, "state")
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    found = rolled(rest)
    for more in sums:
        found = found.unionByName(more)
    return found


# --- ends ---------------------------------------------------------------------------------------


def ends(path: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of nodes where conversations end.

    Ids are joined in runs of 4,096 possible ones first, so the one task that reads a node's ids in order gets
    few rows, and holds one at a time.
    """
    last = path.join(lengths.select("conv_id", F.col("length").alias("depth")), NODE)
    run = F.shiftright(F.col("conv_id").cast("bigint"), 12)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    runs = last.groupBy("node", "depth", run.alias("run")).agg(ids.alias("ids"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for batch in batches:
            done = []
            for node, depth, ids in zip(batch["node"], batch["depth"], batch["ids"]):
                if (node, depth) != at:
                    if digest is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (node, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        if digest is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*NODE, "ends_sha256"])

    kind = dict(path.dtypes)["conv_id"]
    placed = runs.repartition("node", "depth").sortWithinPartitions("node", "depth", "run").drop("run")
    return placed.mapInPandas(rows, f"conv_id {kind}, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, bound: int = BOUND, segment: int = SEGMENT) -> DataFrame:
    """Every node of the trie of ``turns`` (conv_id, depth from 1, role, text) with its figures.

    ``lengths`` (conv_id, length) names every conversation once, those without turns too; ids are integers and
    not null, and the depths of a conversation run from 1 to its length. Null role or text counts as empty; other columns are ignored.
    Result: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves and saved_tokens over the subtree, ends_sha256. Without conversations there is no node.
    """
    ship_package(turns.sparkSession)
    empty = F.lit("")
    plain = turns.select(*NODE, F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    lengths = materialize(lengths.select("conv_id", F.col("length").cast("bigint").alias("length")), "lengths")
    path = paths(plain, lengths, segment)
    own = path.where("conv_id = node")
    children = own.where("depth > 0").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = own.join(children, NODE, "left").select(
        *NODE, "up", "n_convs", "weight",
        F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
        F.col("n_children").isNull().cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"),
    )
    nodes = materialize(counted, "trie")
    result = nodes.join(rollup(nodes, path, bound), NODE).join(ends(path, lengths), NODE, "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return result.select(
        *NODE, F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
