"""Cutting stock by column generation: which mixtures of piece lengths fill a roll, and how often."""

from __future__ import annotations

import numpy as np


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, and how often each size is in it."""
    useful = np.flatnonzero(prices > 1e-12)
    counts = np.zeros(len(sizes), dtype=np.int64)
    if not len(useful):
        return 0.0, counts
    useful = useful[np.argsort(sizes[useful], kind="stable")]
    size, price = sizes[useful], prices[useful]
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fitting = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for room in range(int(size[0]), capacity + 1):
        k = fitting[room]
        worth = best[room - size[:k]] + price[:k]
        i = int(worth.argmax())
        if worth[i] > best[room - 1]:
            best[room], choice[room] = worth[i], i
        else:
            best[room] = best[room - 1]  # leaves a gap; its own choice stays -1
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        counts[useful[choice[room]]] += 1
        room -= int(size[choice[room]])
    return float(best[capacity]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: how often each size) and how often each is used, a fraction.

    The linear program min sum(x) with x·patterns = demand starts from patterns of one size. Its dual
    prices go to the knapsack; a pattern worth more than 1 enters by a simplex step. Farley's bound
    ends the search once the value is within ``gap`` of the optimum.
    """
    m = len(sizes)
    patterns = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / np.diag(patterns))
    used = inverse @ demand.astype(np.float64)

    def enter(column: np.ndarray) -> bool:
        nonlocal inverse, used
        step = inverse @ column
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            return False
        used = np.maximum(used - ratio[leave] * step, 0)
        used[leave] = ratio[leave]
        patterns[leave] = column
        row = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, row)
        inverse[leave] = row
        return True

    # columns that are at hand without a knapsack: a greedy packing of the same demand
    known = np.array([p for p, _ in greedy(sizes, demand, capacity)])
    for _ in range(rounds):
        worth = known @ inverse.sum(axis=0)
        best = int(worth.argmax())
        if worth[best] <= 1 + 1e-6 or not enter(known[best]):
            break
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, column = knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-9 or used.sum() <= (1 + gap) * float(prices @ demand) / worth or not enter(column):
            break
    return patterns, used


def greedy(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First-fit-like patterns that use the demand exactly."""
    left = demand.astype(np.int64).copy()
    out = []
    while left.any():
        pattern = filled(sizes, left, capacity)
        wanted = pattern > 0
        times = int((left[wanted] // pattern[wanted]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def whole_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of rolls of patterns that together use the demand exactly.

    The solution is rounded down; what is left, a few pieces for each pattern, is filled by
    knapsacks that prefer long pieces.
    """
    left = demand.astype(np.int64).copy()
    plan = []
    patterns, used = cutting_stock(sizes, demand, capacity)
    for i in np.argsort(-used, kind="stable"):
        pattern = patterns[i]
        wanted = pattern > 0
        times = min(int(used[i] + 1e-6), int((left[wanted] // pattern[wanted]).min())) if wanted.any() else 0
        if times > 0:
            plan.append((pattern.copy(), times))
            left -= times * pattern
    return plan + greedy(sizes, left, capacity)


def filled(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """One roll: the longest piece left, then the next longest that still fits, and so on."""
    pattern = np.zeros(len(sizes), dtype=np.int64)
    room = capacity
    for i in np.argsort(-sizes, kind="stable"):
        n = min(int(left[i]), room // int(sizes[i]))
        pattern[i] = n
        room -= n * int(sizes[i])
    return pattern
