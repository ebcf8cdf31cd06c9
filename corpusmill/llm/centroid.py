"""Sums over subtrees by centroid decomposition, for a forest in arrays.

In each round every component loses its centroid: the deepest node that holds more than half of its weight. The
totals below the centroid are added to all nodes on the way from it to the component's top;
what hung below it and what lies above become components of their own.
"""

from __future__ import annotations

import numpy as np


def preorder(parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each node in an order where a subtree is one run, and its length. Tops have parent -1."""
    n = len(parent)
    size, place = np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    by_depth = np.lexsort((parent, depth))
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    levels = np.split(by_depth, cuts)
    for level in reversed(levels):
        inner = level[parent[level] >= 0]
        np.add.at(size, parent[inner], size[inner])
    after = 0
    for level in levels:
        tops = level[parent[level] < 0]
        place[tops] = after + np.cumsum(size[tops]) - size[tops]
        after += int(size[tops].sum())
        inner = level[parent[level] >= 0]  # sorted by parent
        if len(inner):
            up = parent[inner]
            earlier = np.cumsum(size[inner]) - size[inner]
            first = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
            earlier -= np.repeat(earlier[first], np.diff(np.append(first, len(up))))
            place[inner] = place[up] + 1 + earlier
    return place, size


def subtree_sums(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each node the sums of ``values`` (n, k) over its subtree, itself included."""
    n = len(parent)
    place, size = preorder(parent, depth)
    at = np.argsort(place)  # from here on nodes are named by their places
    up = np.where(parent[at] >= 0, place[parent[at]], -1)
    size, values = size[at], values[at]
    child = np.sort(up[up >= 0] * n + np.flatnonzero(up >= 0))  # (parent, child)
    top = np.arange(n)
    weight, sums = size.copy(), np.zeros_like(values)
    for x in np.flatnonzero(up < 0):
        top[x : x + size[x]] = x
    left = np.arange(n)
    while len(left):
        heavy = left[2 * weight[left] > weight[top[left]]]
        centre = np.full(n, -1)
        np.maximum.at(centre, top[heavy], heavy)  # deeper nodes of one way down have larger places
        mine = centre[top[left]]
        below = (left >= mine) & (left < mine + size[mine])
        above = (left < mine) & (mine < left + size[left])
        total = np.zeros_like(values)
        np.add.at(total, mine[below], values[left[below]])
        sums[left[above]] += total[mine[above]]
        weight[left[above]] -= weight[mine[above]]
        is_centre = left == mine
        sums[left[is_centre]] += total[left[is_centre]]
        inner, theirs = left[below & ~is_centre], mine[below & ~is_centre]
        top[inner] = child[np.searchsorted(child, theirs * n + inner, side="right") - 1] % n
        left = left[~is_centre]
    return sums[place]
