"""Operator 11: conversations brought into the form system? (user assistant)* by the cheapest edits.

Rows become one letter each for their role and fault. Letters are gathered in blocks of
``BLOCK`` rows, so a conversation of any length is shared out; ``crossing`` finds the edits of a block by
Hirschberg's method. A conversation of several blocks has each block summed up as a table
of four states by four, tables of ``FAN`` blocks as one again, and so on; going down, the same method
finds the states in which the path enters and leaves each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import HOT_ROWS, ranked
from ..session import materialize, ship_package
from .crossing import COST, LETTERS, NEVER, TAIL, TAILS, Elements, crossings, only, summary

BLOCK = 4096
FAN = 512
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ((0, 1), (1, 2), (2, 1))
ACCEPT = -1  # in place of an exit state: the end of a conversation
STATES = "__key string, block bigint, entry int, leave int"


def conversation_key(column: str) -> Column:
    """A string for each conversation id; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def numbered(turns: DataFrame, conv: str = "conv_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``__key, pos, turn, role, text`` of each row, by turn (null first), then role and text; written."""
    plain = turns.select(
        conversation_key(conv).alias("__key"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = ranked(plain, ["__key"], ["turn", "role", "text"], "__rn", hot_rows=hot_rows)
    return materialize(rows.select("__key", (F.col("__rn") - 1).alias("pos"), "turn", "role", "text"), "turns")


def diagnosed(rows: DataFrame) -> DataFrame:
    """``__key, pos, turn, kind, fault``: the initial's number and the first fault of each row, without texts."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = rows.select(
        "__key", "pos", "turn", kind.alias("kind"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("same"),
    )
    # the first row of each content, found with partial aggregation, however often one is repeated; written, so that
    # Spark can split the rows of a common one in the join
    firsts = materialize(narrow.groupBy("__key", "same").agg(F.min("pos").alias("first")), "firsts")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return narrow.join(firsts, ["__key", "same"]).select("__key", "pos", "turn", "kind", fault.alias("fault"))


def blocks_of(faults: DataFrame, block: int) -> DataFrame:
    """``__key, block, codes, follows``: a letter per row, and the next block's first letter; written."""
    must = F.when(F.col("fault").isin("blank", "duplicate"), 4).otherwise(0)
    code = F.col("kind") + must + F.when(F.col("fault") == "truncated", 8).otherwise(0)
    at = F.floor(F.col("pos") / block)
    here = F.array(at, at - 1)
    shared = (F.col("pos") % block == 0) & (F.col("pos") > 0)
    placed = faults.select(
        "__key", "pos", F.char(code + 65).alias("code"), at.alias("own"), F.explode(F.when(shared, here).otherwise(F.slice(here, 1, 1))).alias("block")
    )
    own = F.col("own") == F.col("block")
    listed = F.array_sort(F.collect_list(F.when(own, F.struct("pos", "code"))))
    return materialize(
        placed.groupBy("__key", "block").agg(
            F.array_join(F.transform(listed, lambda r: r["code"]), "").alias("codes"),
            F.coalesce(F.max(F.when(~own, F.col("code"))), F.lit("")).alias("follows"),
        ),
        "blocks",
    )


def letters_of(codes) -> tuple[Elements, np.ndarray, np.ndarray]:
    """Elements of all strings, and where each begins and ends."""
    hi = np.cumsum([len(c) for c in codes], dtype=np.int64)
    return Elements(np.frombuffer("".join(codes).encode(), dtype=np.uint8).astype(np.int64) - 65), hi - [len(c) for c in codes], hi


def ends_for(leave: np.ndarray) -> np.ndarray:
    """Costs by last state: that of the tail, or none but the given state."""
    return np.where((leave == ACCEPT)[:, None], TAIL[None, :], only(np.maximum(leave, 0)))


# --- conversations of more than one block --------------------------------------------------------


def summed(blocks: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cost, order = summary(*letters_of(batch["codes"]))
            flat = {"cost": list(cost.reshape(-1, 16)), "rank": list(order.reshape(-1, 16))}
            yield pd.DataFrame({"__key": batch["__key"], "block": batch["block"], **flat})

    return blocks.mapInPandas(rows, "__key string, block bigint, cost array<bigint>, rank array<bigint>")


def tables_of(group: pd.DataFrame) -> tuple[pd.DataFrame, Elements]:
    group = group.sort_values("block")
    cost, order = (np.stack(group[c].to_list()).astype(np.int64).reshape(-1, 4, 4) for c in ("cost", "rank"))
    return group, Elements(np.arange(len(group)), cost, order)


def folded(level: DataFrame, fan: int) -> DataFrame:
    """Each ``fan`` neighbours as one table."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group, elements = tables_of(group)
        cost, order = summary(elements, np.array([0]), np.array([len(group)]))
        return pd.DataFrame({"__key": group["__key"][:1].to_list(), "block": [int(group["block"].iloc[0]) // fan], "cost": [cost.ravel()], "rank": [order.ravel()]})

    up = level.withColumn("upper", F.floor(F.col("block") / fan))
    return up.groupBy("__key", "upper").applyInPandas(lambda g: fold(g), "__key string, block bigint, cost array<bigint>, rank array<bigint>")


def passed_down(level: DataFrame, upper: DataFrame, fan: int) -> DataFrame:
    """Entry and exit states of the parts of each upper part whose states are known."""
    known = upper.select(F.col("__key"), F.col("block").alias("upper"), "entry", "leave")
    joined = level.withColumn("upper", F.floor(F.col("block") / fan)).join(known, ["__key", "upper"])

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group, elements = tables_of(group)
        entry, leave = group["entry"].to_numpy()[:1], group["leave"].to_numpy()[:1]
        before, after = crossings(elements, np.array([0]), np.array([len(group)]), entry, ends_for(leave))
        if leave[0] == ACCEPT:
            after[-1] = ACCEPT
        return pd.DataFrame({"__key": group["__key"], "block": group["block"], "entry": before, "leave": after})

    return joined.groupBy("__key", "upper").applyInPandas(lambda g: split(g), STATES)


def with_states(blocks: DataFrame, fan: int) -> DataFrame:
    """``blocks`` with the states in which the cheapest path enters and leaves each."""
    long = blocks.where("block > 0").select("__key").distinct()
    whole = [F.lit(0).alias("entry"), F.lit(ACCEPT).alias("leave")]
    if long.isEmpty():
        return blocks.select("*", *whole)
    several = blocks.join(long, "__key", "left_semi")
    levels = [materialize(summed(several), "summary")]
    while not levels[-1].where("block > 0").isEmpty():
        levels.append(materialize(folded(levels[-1], fan), "summary"))
    states = levels[-1].select("__key", "block", *whole)
    for level in reversed(levels[:-1]):
        states = materialize(passed_down(level, states, fan), "states")
    return blocks.join(long, "__key", "left_anti").select("*", *whole).unionByName(several.join(states, ["__key", "block"]))


# --- the edits ----------------------------------------------------------------------------------


def solved(blocks: DataFrame) -> DataFrame:
    """Per block: the letters and the state before each row, cost, illegal pairs, and the inserts of the tail."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            elements, lo, hi = letters_of(batch["codes"])
            leave = batch["leave"].to_numpy()
            before, after = crossings(elements, lo, hi, batch["entry"].to_numpy().astype(np.int64), ends_for(leave))
            cost = np.concatenate(([0], np.cumsum(COST[elements.at, before, after])))
            words = [LETTERS[c][p][q] for c, p, q in zip(elements.at.tolist(), before.tolist(), after.tolist())]
            final = np.where(leave == ACCEPT, after[hi - 1], 0)  # state 0 has no tail
            out = batch[["__key", "block"]].copy()
            out["letters"] = [words[a:b] for a, b in zip(lo, hi)]
            out["states"] = [before[a:b] for a, b in zip(lo, hi)]
            out["cost"] = cost[hi] - cost[lo] + TAIL[final]
            out["tail"], out["final"] = [TAILS[s] for s in final], final
            pairs = [np.frombuffer((c + f).encode(), dtype=np.uint8) - 65 & 3 for c, f in zip(batch["codes"], batch["follows"])]
            out["illegal"] = [sum((a, b) not in LEGAL for a, b in zip(x[:-1].tolist(), x[1:].tolist())) for x in pairs]
            yield out

    schema = "__key string, block bigint, letters array<string>, states array<int>, cost bigint, tail string, final int, illegal bigint"
    return blocks.mapInPandas(rows, schema)


def edits(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(figures by block, diagnosed rows) of ``numbered`` rows; both written."""
    ship_package(rows.sparkSession)
    faults = materialize(diagnosed(rows), "faults")
    return materialize(solved(with_states(blocks_of(faults, block), fan)), "edits"), faults


def repaired(rows: DataFrame, found: DataFrame, block: int = BLOCK) -> DataFrame:
    """The turns after repair: ``__key, pos, part, edit, role, text``; deleted rows are left out.

    ``pos`` is the place of the original row, inserted turns stand before it, those at the end
    beyond the last row.
    """
    each = found.select("__key", "block", F.posexplode(F.arrays_zip("letters", "states")).alias("i", "e"))
    each = each.select("__key", (F.col("block") * block + F.col("i")).alias("pos"), F.col("e.letters").alias("letters"), F.col("e.states").alias("state"))
    own = rows.select("__key", "pos", "role", "text").join(each, ["__key", "pos"])
    nothing = F.lit(None).cast("string")
    tails = found.where("tail != ''").select(
        "__key", (F.col("block") * block + F.size("letters")).alias("pos"), nothing.alias("role"), nothing.alias("text"),
        F.col("tail").alias("letters"), F.col("final").alias("state"),
    )
    every = own.unionByName(tails)

    def turn(i: Column) -> Column:
        edit = F.substring(F.col("letters"), i + 1, F.lit(1))
        # the roles wanted from a state on alternate
        wanted = F.when((F.col("state") == 2) == (i % 2 == 0), "assistant").otherwise("user")
        return F.struct(
            i.alias("part"), edit.alias("edit"), F.when(edit == "K", F.col("role")).otherwise(wanted).alias("role"),
            F.when(edit == "I", F.lit("")).otherwise(F.col("text")).alias("text"),
        )

    turns = F.filter(F.transform(F.sequence(F.lit(0), F.length("letters") - 1), turn), lambda t: t["edit"] != "D")
    return every.select("__key", "pos", F.explode(turns).alias("t")).select("__key", "pos", "t.*")


def digested(turns: DataFrame) -> DataFrame:
    """``__key, repaired_sha256`` of ``role:text`` lines, read in order; no conversation is held in memory."""
    written = turns.select("__key", "pos", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    placed = written.repartition("__key").sortWithinPartitions("__key", "pos", "part")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            done = []
            for k, line in zip(batch["__key"], batch["line"]):
                if k != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pd.DataFrame(done, columns=["__key", "repaired_sha256"])
        if digest is not None:
            yield pd.DataFrame([(key, digest.hexdigest())], columns=["__key", "repaired_sha256"])

    return placed.select("__key", "line").mapInPandas(rows, "__key string, repaired_sha256 string")


def repair_figures(turns: DataFrame, conv: str = "conv_id", block: int = BLOCK, fan: int = FAN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per conversation with rows: faults, the cheapest edits and the digest of the repaired turns.

    Columns: ``__key`` (see ``conversation_key``), gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (null if no turn is left). Null ids are one conversation, null roles and texts count as empty, null turns
    come first, rows of one turn are ordered by role and text, repeated rows are
    duplicates. Other columns are ignored; an empty table has no rows. The audit and the digest are
    one string per conversation, as their definition asks; the digest is read through in one task.
    """
    rows = numbered(turns, conv, hot_rows)
    found, faults = edits(rows, block, fan)
    per_turn = faults.groupBy("__key", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    gap = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counted = per_turn.groupBy("__key").agg(
        F.coalesce(gap, F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    parts = F.array_sort(F.collect_list(F.struct("block", F.concat(F.array_join("letters", ""), "tail").alias("letters"))))
    costs = found.groupBy("__key").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["letters"]), "").alias("audit")
    )
    return counted.join(costs, "__key").join(digested(repaired(rows, found, block)), "__key", "left")
