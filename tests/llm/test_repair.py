"""Repair of conversations against a plain search over edit strings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import crossing, repair
from corpusmill.llm.op11 import damaged

R = random.Random(5)


def cheapest(codes: list[int]) -> tuple[int, str]:
    """Cost and least audit, by keeping the best whole string of each state."""
    best = {crossing.START: (0, "")}
    for code in codes:
        now: dict = {}
        for p, (cost, audit) in best.items():
            for q, (more, letters) in crossing.row_edits(code, p).items():
                edit = (cost + more, audit + letters)
                now[q] = min(now.get(q, edit), edit)
        best = now
    return min((cost + len(crossing.TAILS[p]) * 2, audit + crossing.TAILS[p]) for p, (cost, audit) in best.items())


def explored(codes: list[int]) -> tuple[int, str]:
    """The same by trying every string of edits up to a length, with nothing taken from the operator."""
    roles = "sua?"
    found = []

    def go(i, shape, cost, audit):
        if len(audit) > len(codes) + 3 or cost > 3 * len(codes) + 4:
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", shape):
            found.append((cost, audit))
        if not any(re.fullmatch("(s?(ua)+)?", shape + rest) for rest in ("", "ua", "a")):
            return
        for role in "ua":
            go(i, shape + role, cost + 2, audit + "I")
        if i < len(codes):
            late = 1 if codes[i] & 8 else 0
            go(i + 1, shape, cost + 3, audit + "D")
            if not codes[i] & 4:
                go(i + 1, shape + roles[codes[i] & 3], cost + late, audit + "K")
                for role in "ua":
                    go(i + 1, shape + role, cost + 2 + late, audit + "R")

    go(0, "", 0, "")
    return min(found)


def random_codes(n: int) -> list[int]:
    return [R.choice([0, 1, 1, 2, 2, 3]) + R.choice([0, 0, 0, 4, 8]) for _ in range(n)]


def spelled(elements, lo, hi, before, after) -> str:
    return "".join(crossing.LETTERS[elements.at[i]][before[i]][after[i]] for i in range(lo, hi)) + crossing.TAILS[after[hi - 1]]


def test_plain_search_equals_trying_everything():
    for _ in range(150):
        codes = random_codes(R.randint(0, 4))
        assert cheapest(codes) == explored(codes)


def test_crossings_give_the_least_audit():
    many = [random_codes(R.choice([1, 2, 3, 5, 8, 13, 40, 90])) for _ in range(400)]
    elements, lo, hi = repair.letters_of(["".join(chr(65 + c) for c in codes) for codes in many])
    before, after = crossing.crossings(elements, lo, hi, np.zeros(len(lo), np.int64), repair.ends_for(np.full(len(lo), repair.ACCEPT)))
    for codes, a, b in zip(many, lo, hi):
        cost, audit = cheapest(codes)
        assert spelled(elements, a, b, before, after) == audit
        assert crossing.COST[elements.at[a:b], before[a:b], after[a:b]].sum() + 2 * len(crossing.TAILS[after[b - 1]]) == cost


def want(rows):
    """All columns of the contract for one conversation's rows (turn, role, text), plainly."""
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes, faults = set(), [], []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        kind = "sua".find(role[:1]) if role else -1
        codes.append((kind if kind >= 0 else 3) + (4 if fault in ("blank", "duplicate") else 0) + (8 if fault == "truncated" else 0))
    cost, audit = cheapest(codes)
    state, left, out = crossing.START, list(rows), []
    for letter in audit:
        row = left.pop(0) if letter != "I" else None
        if letter == "D":
            continue
        role = row[1] if letter == "K" else ("assistant" if state == crossing.USER else "user")
        out.append(role + ":" + ("" if row is None else row[2]))
        state = crossing.NEXT[state, role[:1]]
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def odd_rows():
    texts = ["ok.", "ok", "", " \n", "a!", "b? ", "ü", "x" * 20_000, None]
    roles = ["system", "user", "assistant", "tool", "", "sys", "User", None]
    rows = [(k, R.choice([None, 0, 1, 2, 3, 5, 8]), R.choice(roles[:3] if R.random() < 0.8 else roles), R.choice(texts)) for k in range(60) for _ in range(R.randint(1, 14))]
    rows += [(None, t, "user", "null id.") for t in range(3)] + [(99, None, "user", "x"), (99, None, "user", "x")]
    return rows + [(98, t, R.choice(["user", "assistant"]), f"{t}.") for t in range(300)]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, "a", 1) for r in odd_rows()], "conv_id long, turn long, role string, text string, pos string, block long")


@pytest.mark.parametrize("block, fan, hot", [(4096, 512, 10**6), (4, 3, 10**6), (7, 2, 50)])
def test_figures(turns, block, fan, hot):
    by_conversation: dict = {}
    for r in turns.collect():
        by_conversation.setdefault("" if r["conv_id"] is None else f"={r['conv_id']}", []).append((r["turn"], r["role"], r["text"]))
    got = {r["__key"]: r.asDict() for r in repair.repair_figures(turns, block=block, fan=fan, hot_rows=hot).collect()}
    assert set(got) == set(by_conversation)
    nothing = hashlib.sha256(b"").hexdigest()
    for key, rows in by_conversation.items():
        expected = want(rows)
        found = {k: got[key][k] for k in expected}
        found["repaired_sha256"] = found["repaired_sha256"] or nothing
        assert found == expected, (key, rows)


def test_empty_table(turns):
    assert repair.repair_figures(turns.where("false")).count() == 0


def test_repaired_turns_alternate(turns):
    rows = repair.numbered(turns)
    found, _ = repair.edits(rows)
    shapes: dict = {}
    for r in sorted(repair.repaired(rows, found).collect(), key=lambda r: (r["__key"], r["pos"], r["part"])):
        shapes[r["__key"]] = shapes.get(r["__key"], "") + r["role"][:1]
    assert shapes and all(re.fullmatch("(s?(ua)+)?", s) for s in shapes.values())


def test_query(spark, folder):
    """The registered query on its whole table against the plain search, damage included."""
    from corpusmill.llm.queries import QUERIES

    rows, whole = {}, spark.read.parquet(f"{folder}/conversations.parquet").collect()
    for r in whole:
        fate = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", r["text"]) if fate == 2 else r["text"]
        mine = rows.setdefault(r["conv_id"], [])
        mine += [(r["turn"], "user" if fate == 4 else r["role"], text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = {r["conv_id"]: r.asDict() for r in QUERIES["op11_repair"](spark, folder).collect()}
    assert got.keys() == rows.keys()
    for conv, mine in rows.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == want(mine)


def test_damage_takes_nulls_for_a_space(spark):
    table = spark.createDataFrame([(None, None, None, None), (1, 7, None, None)], "conv_id long, turn long, role string, text string")
    assert all(r["role"] in (" ", "user") and r["text"] in (" ", "") for r in damaged(table).collect())


def test_query_equals_sql(spark, folder):
    import oracle

    from corpusmill.llm.queries import ORACLES, QUERIES

    assert oracle.compare(oracle.connect(folder), QUERIES["op11_repair"](spark, folder), ORACLES["op11_repair"]) == []
