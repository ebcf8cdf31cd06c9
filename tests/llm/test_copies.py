"""Exact copies against a plain grouping, on odd rows."""

from __future__ import annotations

import hashlib
import string

import pytest

from corpusmill.llm import copies

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ROWS = [
    (1, "One text", "a"), (2, "one TEXT", "b"), (3, "one text ", "c"), (4, None, "d"), (5, "", "e"), (6, "Ärger", "f"), (7, "ärger", "g"),
    (8, "İstanbul ſ K", "h"), (9, "i̇stanbul ſ k", "i"), (10, "x" * 300_000, "j"), (11, "X" * 300_000, "k"), (11, "X" * 300_000, "l"),
    (None, "one text", "m"), (None, "alone", "n"), (None, "alone", "o"), (12, "\x00A", "p"), (13, "\x00a", "q"), (14, "漢字 A", "r"), (15, "漢字 a", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    hot = [(100 + k, "Hot" if k % 2 else "hot", str(k)) for k in range(400)]
    rows = [(i, t, e, "row") for i, t, e in ROWS + hot]
    return spark.createDataFrame(rows, "doc_id long, text string, __digest string, __row string")


def wanted(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r["text"] or "").translate(LOWER), []).append(r["doc_id"])
    return {t: (max((i for i in ids if i is not None), default=None), len(ids), ids) for t, ids in groups.items()}


@pytest.mark.parametrize("support", [0.001, 0.1])
def test_groups(docs, support):
    groups = wanted(docs.collect())
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    found = {}
    for r in copies.exact_copies(docs, support=support).collect():
        keep, size, _ = by_digest[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (keep, size) and (not r["kept"] or r["doc_id"] == keep)
        found.setdefault(r["text_sha256"], []).append(r)
    assert {d: sorted(map(str, g[2])) for d, g in by_digest.items()} == {d: sorted(str(r["doc_id"]) for r in rs) for d, rs in found.items()}
    assert all(sum(r["kept"] for r in rs) == 1 for rs in found.values())
    assert copies.exact_copies(docs.where("false")).count() == 0


@pytest.mark.parametrize("support", [0.001, 0.1])
def test_rows_that_stay(docs, support):
    kept = copies.without_copies(docs, support=support)
    assert kept.columns == docs.columns
    all_rows = {tuple(r) for r in docs.collect()}
    got = kept.collect()
    assert all(tuple(r) in all_rows for r in got)
    want = sorted((t, str(g[0])) for t, g in wanted(docs.collect()).items())
    assert sorted(((r["text"] or "").translate(LOWER), str(r["doc_id"])) for r in got) == want
    assert copies.without_copies(docs.where("false")).count() == 0


def test_frequent_digests_are_few_and_verified(docs):
    rows = copies.digests(docs, "doc_id", "text")
    found = copies.frequent(rows, 0.1).collect()
    assert len(found) <= 10 and max(r["__n"] for r in found) == 400
    assert all(r["__n"] == rows.where(rows["__digest"] == r["__digest"]).count() for r in found)


def test_no_python_in_the_plan(docs):
    plan = copies.exact_copies(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


def test_query_equals_sql(spark, folder):
    import oracle

    from corpusmill.llm.queries import ORACLES, QUERIES

    for name in ("op13_exact_copies",):
        assert oracle.compare(oracle.connect(folder), QUERIES[name](spark, folder), ORACLES[name]) == []
