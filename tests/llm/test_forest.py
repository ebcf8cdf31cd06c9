"""The forest's depth follows the data, and no link at the threshold is lost."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusmill.llm import jaccard

R = random.Random(31)


def changed(words: list[str], n: int) -> list[str]:
    """Some words in a row replaced, so that the share of shingles that stay is known."""
    at = R.randrange(10, len(words) - n - 10)
    return [*words[:at], *(f"x{R.randrange(10**9)}" for _ in range(n)), *words[at + n :]]


def jaccard_of(a: list[str], b: list[str]) -> float:
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def sums_of(similarities: list[float], depth: int) -> np.ndarray:
    s = np.array(similarities)
    chances = [jaccard.recall(s, d) for d in range(1, jaccard.DEEPEST + 1)] + [np.ones(len(s))]
    return np.array([(c / chances[depth - 1]).sum() for c in chances])


def test_depth_follows_the_links():
    assert jaccard.shortened(sums_of([0.97] * 100_000, 8), 8, 0.8, 0.9999) == 8
    assert jaccard.shortened(sums_of([0.8] * 100_000, 8), 8, 0.8, 0.9999) == 5
    middle = jaccard.shortened(sums_of([0.84] * 100_000, 8), 8, 0.8, 0.9999)
    assert 5 < middle < 8
    assert jaccard.shortened(sums_of([0.8] * 1000, 5), 5, 0.8, 0.9999) == 5
    assert jaccard.shortened(np.zeros(9), 8, 0.8, 0.9) == 8


@pytest.mark.parametrize("cut, rounds", [((14, 19), 2), ((1, 1), 1)])
def test_links_near_the_threshold(spark, monkeypatch, cut, rounds):
    rows, want = [], set()
    for k in range(600):
        words = [f"w{R.randrange(50_000)}" for _ in range(190)]
        rows.append((2 * k, " ".join(words)))
        other = changed(words, R.randint(*cut))
        rows.append((2 * k + 1, " ".join(other)))
        if jaccard_of(words, other) >= 0.8:
            want.add(2 * k)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    depths = []
    plain = jaccard.compared

    def seen(docs, classes, depth, *rest):
        depths.append(depth)
        return plain(docs, classes, depth, *rest)

    monkeypatch.setattr(jaccard, "compared", seen)
    target = 0.9999 if rounds > 1 else 0.999
    got = jaccard.similar(table, target=target).where("n_links > 0").collect()
    found = {r["doc_id"] for r in got if r["doc_id"] % 2 == 0}
    assert depths[0] == jaccard.DEEPEST and len(depths) == rounds
    assert found <= want and len(found) >= 0.999 * len(want) and len(want) > 150
