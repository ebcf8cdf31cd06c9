"""Least-cost paths through four states by Hirschberg's divide and conquer, for many sequences at once.

States: at the start, after a system, a user, an assistant turn. Each element of a sequence (a row,
or a whole block of rows) is a 4 x 4 table of least costs between the state before and after it,
with the order of the least edit strings of those costs among the states after it.

Edit strings of one cost are compared by their letters. Strings that lead from one state to different states over
the same rows never begin one another: each ends with the letter of the last row. So the order of
two strings is decided where they part, and four ranks beside four costs carry it forward.
"""

from __future__ import annotations

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that an inserted or renamed turn leads to.
WANTED = (USER, USER, ASSISTANT, USER)
INITIALS = "sua"  # any other initial is the fourth kind of row
MUST, OPEN_END = 4, 8  # bits of a row's code beside its kind: has to go, is truncated
INSERT, RENAME, DELETE, TRUNCATED = 2, 2, 3, 1
NEVER = 1 << 40
#: What ends a conversation from each state, and its cost.
TAILS = ("", "II", "I", "")
TAIL = np.array([INSERT * len(t) for t in TAILS], dtype=np.int64)


def row_edits(code: int, state: int) -> dict[int, tuple[int, str]]:
    """By state after a row: cost and letters of the cheapest inserts and edit, the least letters of those."""
    kind, must, late = code & 3, code & MUST, TRUNCATED * bool(code & OPEN_END)
    found: dict[int, tuple[int, str]] = {}
    for inserts in range(4):  # a fourth state would be one seen before
        ends = [(state, DELETE, "D")]
        if not must:
            ends.append((WANTED[state], RENAME + late, "R"))
            kept = NEXT.get((state, INITIALS[kind])) if kind < 3 else None
            if kept is not None:
                ends.append((kept, late, "K"))
        for after, cost, letter in ends:
            edit = (cost + INSERT * inserts, "I" * inserts + letter)
            found[after] = min(found.get(after, edit), edit)
        state = WANTED[state]
    return found


LETTERS = [[[row_edits(code, p).get(q, (NEVER, ""))[1] for q in range(4)] for p in range(4)] for code in range(16)]
COST = np.array([[[row_edits(code, p).get(q, (NEVER, ""))[0] for q in range(4)] for p in range(4)] for code in range(16)], dtype=np.int64)
ORDER = np.array([[[sorted(row).index(letters) for letters in row] for row in table] for table in LETTERS], dtype=np.int64)


class Elements:
    """Elements of concatenated sequences: places in a list of tables."""

    def __init__(self, at: np.ndarray, cost: np.ndarray = COST, order: np.ndarray = ORDER):
        self.at, self.cost, self.order = at, cost, order


def only(states: np.ndarray) -> np.ndarray:
    """Cost vectors that allow one state each."""
    out = np.full((len(states), 4), NEVER, dtype=np.int64)
    out[np.arange(len(states)), states] = 0
    return out


def step(cost: np.ndarray, rank: np.ndarray, by: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.minimum(cost[:, :, None] + by, NEVER)
    best = (total * 4 + rank[:, :, None]).argmin(axis=1)
    rows, after = np.arange(len(cost))[:, None], np.arange(4)[None, :]
    now = total[rows, best, after]
    value = np.where(now < NEVER, rank[rows, best] * 4 + order[rows, best, after], 99)
    return now, (value[:, None, :] < value[:, :, None]).sum(axis=2).clip(max=3)


def forward(elements: Elements, lo: np.ndarray, n: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and ranks by state after the ``n`` elements from ``lo``."""
    by_length = np.argsort(-n, kind="stable")
    lo, n, cost = lo[by_length], n[by_length], cost[by_length]
    rank = np.zeros_like(cost)
    for t in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -t))
        at = elements.at[lo[:live] + t]
        cost[:live], rank[:live] = step(cost[:live], rank[:live], elements.cost[at], elements.order[at])
    back = np.argsort(by_length)
    return cost[back], rank[back]


def backward(elements: Elements, hi: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs by state before the ``n`` elements up to ``hi``."""
    by_length = np.argsort(-n, kind="stable")
    hi, n, cost = hi[by_length], n[by_length], ends[by_length]
    for t in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -t))
        table = elements.cost[elements.at[hi[:live] - 1 - t]]
        cost[:live] = np.minimum((table + cost[:live, None, :]).min(axis=2), NEVER)
    return cost[np.argsort(by_length)]


def crossings(elements: Elements, lo: np.ndarray, hi: np.ndarray, entry: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State before and after each element on the cheapest path, the least edit string among those.

    The vectors from both sides meet in the middle of every open part at once; the crossing state of least cost, and
    of the least string before it, splits the part in two. Only vectors are kept beside the result.
    """
    before = np.zeros(len(elements.at), dtype=np.int64)
    after = np.zeros(len(elements.at), dtype=np.int64)
    some = hi > lo
    lo, hi, entry, ends = lo[some], hi[some], entry[some], ends[some]
    while len(lo):
        one = hi - lo == 1
        rows, at = lo[one], elements.at[lo[one]]
        total = np.minimum(elements.cost[at, entry[one]] + ends[one], NEVER)
        before[rows], after[rows] = entry[one], (total * 4 + elements.order[at, entry[one]]).argmin(axis=1)
        lo, hi, entry, ends = lo[~one], hi[~one], entry[~one], ends[~one]
        mid = (lo + hi) // 2
        cost, rank = forward(elements, lo, mid - lo, only(entry))
        total = np.minimum(cost + backward(elements, hi, hi - mid, ends), NEVER)
        cross = (total * 4 + rank).argmin(axis=1)
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
        entry, ends = np.concatenate((entry, cross)), np.concatenate((only(cross), ends))
    return before, after


def summary(elements: Elements, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sequence as one element: costs and orders, both (n, 4, 4)."""
    found = [forward(elements, lo, hi - lo, only(np.full(len(lo), p))) for p in range(4)]
    return np.stack([c for c, _ in found], axis=1), np.stack([r for _, r in found], axis=1)
