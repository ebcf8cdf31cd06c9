"""Run a query on Spark and its SQL on DuckDB, and compare all rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, float(value)) if not (isinstance(value, float) and math.isnan(value)) else (3, "nan")
    return (4, str(value))


def compare(con, df, sql: str, tolerance: float = 2e-6) -> list[str]:
    """Differences found, empty when all is equal."""
    names = sorted(df.columns)
    relation = con.execute(sql)
    described = [d[0] for d in relation.description]
    if sorted(described) != names:
        return [f"columns {names} and {sorted(described)}"]
    places = [described.index(n) for n in names]
    theirs = [tuple(row[i] for i in places) for row in relation.fetchall()]
    ours = [tuple(row[n] for n in names) for row in df.collect()]
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} and {len(theirs)}"]
    order = lambda row: tuple(_key(v) for v in row)
    problems = []
    for a, b in zip(sorted(ours, key=order), sorted(theirs, key=order)):
        for name, x, y in zip(names, a, b):
            if type(x) is not type(y) and not (x is None and y is None):
                problems.append(f"{name}: {x!r} ({type(x).__name__}) and {y!r} ({type(y).__name__})")
            elif isinstance(x, float):
                if x != y and not (math.isnan(x) and math.isnan(y)) and abs(x - y) > tolerance:
                    problems.append(f"{name}: {x!r} and {y!r}")
            elif x != y:
                problems.append(f"{name}: {x!r} and {y!r}")
        if len(problems) > 5:
            break
    return problems
