"""Lone pairs of vectors among many buckets."""

from __future__ import annotations

import numpy as np
import pytest

from corpusmill.llm import neighbours


def planted(n: int, width: int, pairs: int, cosine: float, seed: int):
    """Random vectors, and as many partners of some of them at a given cosine."""
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, width))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, width))
    side -= (side * rows[:pairs]).sum(axis=1, keepdims=True) * rows[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.concatenate((rows, cosine * rows[:pairs] + np.sqrt(1 - cosine**2) * side))


@pytest.mark.parametrize("cosine", [0.91])
def test_lone_pairs_are_found(spark, monkeypatch, cosine):
    monkeypatch.setattr(neighbours, "BUCKET", 4)  # many buckets for few vectors
    monkeypatch.setattr(neighbours, "TABLES", 8)
    monkeypatch.setattr(neighbours, "AUDITED", 20)  # a sample that meets next to no link
    monkeypatch.setattr(neighbours, "AUDITS", 40)
    rows = planted(1200, 48, 60, cosine, 3)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    sims = rows @ rows.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(sims >= 0.9)) if i < j}
    found = {(r["component_id"], r["vec_id"]) for r in neighbours.near_duplicates(table, least=0.98).collect() if r["component_id"] != r["vec_id"]}
    assert len(want) >= 60 and found <= want  # here every group is a pair
    assert len(found) >= 0.9 * len(want)


def test_no_link_is_no_evidence(spark):
    rows = planted(300, 64, 0, 0.9, 5)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, raw array<double>")
    distinct, dtype = neighbours.distinct_vectors(table, "id", "raw")
    distinct = distinct.withColumn("root", distinct["id"])
    roots = spark.createDataFrame([], "id long, root long")
    assert neighbours.audit(distinct, dtype, roots, 0.9) is None
    fresh = neighbours.first_graph(distinct, dtype, 0.9, 300, 1)
    assert neighbours.recaptured(fresh, roots) is None
