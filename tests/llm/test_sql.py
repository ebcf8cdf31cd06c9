"""Registered queries against their SQL, on whole tables."""

from __future__ import annotations

import oracle
import pytest

from corpusmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op2_repeats", "op3_jaccard_join", "op8_arc_to_warc", "op9_near_vectors"])
def test_query_equals_sql(spark, folder, name):
    assert oracle.compare(oracle.connect(folder), QUERIES[name](spark, folder), ORACLES[name]) == []
