"""The prefix trie against plain sets of prefixes."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import trie
from corpusmill.llm.centroid import subtree_sums
from corpusmill.llm.op12 import rebuilt

R = random.Random(9)


def test_subtree_sums():
    for n in (1, 2, 3, 7, 40, 300):
        for shape in ("chain", "star", "random", "forest", "caterpillar"):
            up = {
                "chain": [i - 1 for i in range(n)], "star": [-1] + [0] * (n - 1), "random": [-1] + [R.randrange(i) for i in range(1, n)],
                "forest": [R.randrange(-1, i) for i in range(n)], "caterpillar": [-1] + [i - 1 if i % 2 else max(0, i - 2) for i in range(1, n)],
            }[shape]
            depth = [0] * n
            for i in range(n):
                depth[i] = 0 if up[i] < 0 else depth[up[i]] + 1
            values = np.array([[R.randint(0, 9), 1] for _ in range(n)])
            want = values.copy()
            for i in reversed(range(n)):
                if up[i] >= 0:
                    want[up[i]] += want[i]
            names = R.sample(range(n), n)  # any order of the nodes
            parent = np.array([-1 if up[i] < 0 else names.index(up[i]) for i in names])
            got = subtree_sums(parent, np.array(depth)[names], values[names])
            assert (got == want[names]).all()


def plain_rebuilt(rows):
    own: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(rs)] for c, rs in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:]
    return out


def plain_trie(whole):
    members: dict = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums: dict = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums[k] for k in children.get(p, [])]
        sums[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * words)
    rows = set()
    for p, cs in members.items():
        done = sorted(c for c in cs if len(whole[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        sha = hashlib.sha256(",".join(map(str, done)).encode()).hexdigest()
        rows.add((min(cs), len(p), up, len(cs), len(children.get(p, [])), *sums[p], sha))
    return rows


def odd_rows():
    texts = ["a b", "a  b", "", None, "ü x y", "z" * 9000]
    rows = [(c, R.choice([0, 1, 2, 2, None]), R.choice(["user", "assistant", None]), R.choice(texts)) for c in [*range(-3, 50), *range(60, 100, 4)] for _ in range(R.randint(1, 5))]
    rows += [(200 + c, t, "user", f"turn {t}") for c in range(0, 60, 20) for t in range(40 + c)]  # one inside the other
    rows += [(5000 * c, 0, "system", "the same") for c in range(1, 9) for _ in range(4)]  # far apart, all alike
    return rows + [(None, 0, "user", "nobody's"), (7, 1, "user", "twice"), (7, 1, "user", "twice")]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in odd_rows()], "conv_id long, turn long, role string, text string, depth long, node string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("bound, segment, hot", [(100_000, 4096, 10**6), (60, 7, 30), (3, 16, 10**6)])
def test_nodes(turns, bound, segment, hot):
    rows = [tuple(r)[:4] for r in turns.collect()]
    found = trie.prefix_trie(*rebuilt(turns, hot), bound=bound, segment=segment)
    got = [tuple(r[c] for c in COLUMNS) for r in found.collect()]
    want = plain_trie(plain_rebuilt(rows))
    assert len(got) == len(want) and set(got) == want


def test_no_conversations(turns):
    assert trie.prefix_trie(*rebuilt(turns.where("false"))).count() == 0


def test_query_equals_sql(spark, folder):
    import oracle

    from corpusmill.llm.queries import ORACLES, QUERIES

    assert oracle.compare(oracle.connect(folder), QUERIES["op12_prefix_trie"](spark, folder), ORACLES["op12_prefix_trie"]) == []
