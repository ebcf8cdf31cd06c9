"""Operator 9: near-duplicate vectors by NN-descent.

A first neighbour graph comes from random hyperplanes: vectors with the same signs are compared in one
task. It is refined in rounds: each vector's neighbours, both ways, are compared with each other, since a
neighbour's neighbour is likely a neighbour. Rounds end when they find next to no new link.
Lists hold a few neighbours, but no link found is lost with them: every comparison also says which of its
vectors its links connect. While a list is full of links (saturated), the search goes on for neighbours outside the group
that the links connect. Groups are then compared block by block, and only counts leave a task. A sample of
vectors is compared with all others to audit the recall, and fresh hyperplanes tell it as well: it is the share of the links
they find that are known, which speaks where links are too few for a sample to meet one. While either is too
low, the fresh links are added and more hyperplanes tried; if that does not help, all vectors are
compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .components import components

LIST = 10  # neighbours kept per vector, and of those that have it as one
TABLES = 12
BUCKET = 128  # vectors with the same signs that are aimed at
CHUNK = 1024  # larger ones are compared block by block
BLOCK = 256
AUDITED = 1000
AUDITS = 12
FRESH = 10_000  # seeds of the searches that only audit
#: Entries of lists, and connections (link): u and v are in one group by links that one comparison has found.
EDGES = "u bigint, v bigint, sim double, link boolean"


def unit(raw, dtype: str) -> np.ndarray:
    """Rows of unit length in double precision."""
    rows = np.frombuffer(b"".join(raw), dtype=dtype).astype(np.float64).reshape(len(raw), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_width(raw, dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit rows of the vectors of each length; those of different lengths are never compared."""
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, unit([raw[i] for i in at], dtype)


def distinct_vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, str]:
    """Equal vectors once: id (the smallest), copies, raw. Null, zero and not finite ones are left out."""
    dtype = "<f4" if "float" in df.schema[vector].dataType.simpleString() else "<f8"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = []
            for x in batch[vector]:
                # a null component becomes a NaN
                row = np.zeros(0) if x is None else np.array(x, dtype=np.float64)
                good = len(row) and np.isfinite(row).all() and row.any()
                raw.append((row + 0.0).astype(dtype).tobytes() if good else None)
            out = pd.DataFrame({"id": batch[key], "raw": raw})
            yield out[out["raw"].notna()]

    sound = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), vector)
    return sound.mapInPandas(rows, "id bigint, raw binary"), dtype


def best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest values of each row."""
    k = min(k, sims.shape[1])
    columns = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(sims)), k), columns.ravel()


def joined(linked: np.ndarray) -> np.ndarray:
    """The first place that each place is connected to."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label, len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def entries(u: np.ndarray, v: np.ndarray, sim: np.ndarray | float, link: bool) -> pd.DataFrame:
    return pd.DataFrame({"u": u, "v": v, "sim": sim, "link": link})


def compare_bucket(key: tuple, group: pd.DataFrame, dtype: str, threshold: float, k: int) -> pd.DataFrame:
    """Entries and connections of a block; of two blocks, what their links connect beyond each of them."""
    _, x, y = key
    group = group.sort_values("id")  # groups are named by their least id
    parts = [entries(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), False)]
    ids, roots, chunk = (group[c].to_numpy() for c in ("id", "root", "chunk"))
    for at, rows in by_width(group["raw"].tolist(), dtype):
        if len(at) < 2:
            continue
        sims = rows @ rows.T
        linked = sims >= threshold
        first, own = joined(linked), np.arange(len(at))
        inner = own if x == y else joined(linked & (chunk[at][:, None] == chunk[at]))
        bound = np.flatnonzero((inner == own) & (first != own))
        parts.append(entries(ids[at[bound]], ids[at[first[bound]]], 0.0, True))
        if x == y:
            sims[roots[at][:, None] == roots[at]] = -2
            i, j = best(sims, min(k, len(at) - 1))
            i, j = i[sims[i, j] > -2], j[sims[i, j] > -2]
            parts.append(entries(ids[at[i]], ids[at[j]], sims[i, j], False))
    return pd.concat(parts)


def first_graph(table: DataFrame, dtype: str, threshold: float, n: int, seed: int, tables: int = TABLES) -> DataFrame:
    """Edges between vectors on the same side of random hyperplanes. All vectors of a bucket are compared."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / BUCKET)))))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = batch["raw"].tolist()
            codes = np.zeros((len(raw), tables), dtype=np.int64)
            for at, unit_rows in by_width(raw, dtype):
                width = unit_rows.shape[1]
                planes = np.random.default_rng((seed, width)).standard_normal((width, tables * bits))
                signs = (unit_rows @ planes > 0).reshape(len(at), tables, bits)
                codes[at] = (signs << np.arange(bits)).sum(axis=2) if bits else 0
            buckets = codes * tables + np.arange(tables)
            yield pd.DataFrame({"id": batch["id"], "root": batch["root"], "raw": raw, "buckets": buckets.tolist()})

    marked = table.select("id", "root", "raw").mapInPandas(rows, "id bigint, root bigint, raw binary, buckets array<bigint>")
    each = marked.select("id", "root", "raw", F.explode("buckets").alias("bucket"))
    large = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    chunks = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1))
    dealt = each.join(large, "bucket", "left").withColumns({"chunk": F.pmod(F.xxhash64("id"), chunks), "chunks": chunks})
    dealt = met(dealt).select("id", "root", "raw", "bucket", "chunk", "x", "y")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return compare_bucket(key, group, dtype, threshold, LIST // 2)

    return dealt.groupBy("bucket", "x", "y").applyInPandas(compare, EDGES)


def met(blocks: DataFrame) -> DataFrame:
    """Each row once for each pair of blocks (x, y) that its own block, ``chunk`` of ``chunks``, is one of."""
    every = F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)
    return blocks.withColumn("o", F.explode(every)).withColumns({"x": F.least("chunk", "o"), "y": F.greatest("chunk", "o")})


def nearest(edges: DataFrame) -> DataFrame:
    """The best LIST entries of each vector, and all connections."""
    once = edges.groupBy("u", "v", "link").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u", "link").orderBy(F.desc("sim"), "v"))
    return once.withColumn("rank", rank).where(F.col("link") | (F.col("rank") <= LIST)).select("u", "v", "sim", "link")


def refined(graph: DataFrame, table: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """Edges between the neighbours of each vector that are better than the worst they have, and what their links connect."""
    graph = graph.where("NOT link")
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    back = back.withColumn("rank", rank).where(F.col("rank") <= LIST).drop("rank")
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n"))
    worst = worst.select(F.col("u").alias("v"), F.when(F.col("n") < LIST, -2.0).otherwise(F.col("worst")).alias("worst"))
    pairs = graph.select("u", "v").unionByName(back.select("u", "v")).distinct()
    vectors = table.select(F.col("id").alias("v"), "root", "raw").join(worst, "v", "left")
    lists = pairs.join(vectors, "v").groupBy("u").agg(F.collect_list(F.struct("v", "root", "raw", "worst")).alias("near"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for near in batch["near"]:
                near = sorted(near, key=lambda x: x["v"])
                ids, roots = (np.array([x[c] for x in near]) for c in ("v", "root"))
                least = np.array([-2.0 if x["worst"] is None else x["worst"] for x in near])
                for at, unit_rows in by_width([x["raw"] for x in near], dtype):
                    if len(at) < 2:
                        continue
                    sims = unit_rows @ unit_rows.T
                    first = joined(sims >= threshold)
                    bound = np.flatnonzero(first != np.arange(len(at)))
                    out.append((ids[at[bound]], ids[at[first[bound]]], np.zeros(len(bound)), np.ones(len(bound), dtype=bool)))
                    sims[roots[at][:, None] == roots[at]] = -3
                    i, j = np.nonzero(sims > least[at][:, None])
                    out.append((ids[at[i]], ids[at[j]], sims[i, j], np.zeros(len(i), dtype=bool)))
            if out:
                u, v, sim, link = (np.concatenate(c) for c in zip(*out))
                yield entries(u, v, sim, link)

    return lists.mapInPandas(rows, EDGES)


def descended(table: DataFrame, dtype: str, threshold: float, n: int, seed: int, start: DataFrame | None) -> DataFrame:
    edges = first_graph(table, dtype, threshold, n, seed)
    graph = materialize(nearest(edges if start is None else edges.unionByName(start)), "graph")
    near = ~F.col("link") & (F.col("sim") >= threshold)
    links = graph.where(near).count()
    while True:  # lists only get better, so it ends
        graph = materialize(nearest(graph.unionByName(refined(graph, table, dtype, threshold))), "graph")
        now = graph.where(near).count()
        if now <= 1.001 * links:
            break
        links = now
    return graph


def groups_of(graph: DataFrame) -> DataFrame:
    return materialize(components(graph.where("link").select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots")


def saturated(graph: DataFrame, threshold: float) -> bool:
    """Whether there is a list that holds nothing but links."""
    lists = graph.where(~F.col("link") & (F.col("sim") >= threshold)).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return not lists.where(F.col("n") >= LIST).isEmpty()


def outside(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """All connections, and the entries of lists that lead out of their group."""
    of_u = roots.select(F.col("id").alias("u"), F.col("root").alias("ru"))
    of_v = roots.select(F.col("id").alias("v"), F.col("root").alias("rv"))
    led = graph.join(of_u, "u", "left").join(of_v, "v", "left")
    return led.where(F.col("link") | ~F.coalesce(F.col("ru") == F.col("rv"), F.lit(False))).select("u", "v", "sim", "link")


def recaptured(fresh: DataFrame, roots: DataFrame) -> float | None:
    """The share of the connections of a fresh search whose ends are in one known group; None if it has found none.

    Like the audit a mean over groups, so that a large one weighs no more than a pair.
    """
    side = roots.select(F.col("id").alias("u"), F.col("root").alias("ru"))
    other = roots.select(F.col("id").alias("v"), F.col("root").alias("rv"))
    links = fresh.where("link").select("u", "v").distinct().join(side, "u", "left").join(other, "v", "left")
    known = F.coalesce(F.col("ru") == F.col("rv"), F.lit(False)).cast("double")
    each = links.groupBy(F.coalesce("ru", "u").alias("root")).agg(F.avg(known).alias("known"))
    return each.agg(F.avg("known")).first()[0]


def audit(table: DataFrame, dtype: str, roots: DataFrame, threshold: float) -> float | None:
    """The share of the links of a vector, found by comparing it with all, whose ends are in one group; each of them is counted.

    None if none of the vectors has a link.

    It is the mean over AUDITED vectors within a group, and of these means over the groups, so that a
    large group weighs no more than a pair.
    """
    spark = table.sparkSession
    asked = table.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(AUDITED).select("id", "raw").toPandas()
    shared = spark.sparkContext.broadcast((asked["id"].to_numpy(), [bytes(x) for x in asked["raw"]]))  # AUDITED vectors

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, raw = shared.value
        queries = list(by_width(raw, dtype))
        for batch in batches:
            ids = batch["id"].to_numpy()
            for at, unit_rows in by_width(batch["raw"].tolist(), dtype):
                for q, query_rows in queries:
                    if query_rows.shape[1] != unit_rows.shape[1]:
                        continue
                    i, j = np.nonzero(query_rows @ unit_rows.T >= threshold)
                    a, b = names[q[i]], ids[at[j]]
                    yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    links = table.select("id", "raw").mapInPandas(rows, "a bigint, b bigint")
    side = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    other = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    each = links.join(side, "a", "left").join(other, "b", "left").groupBy("a").agg(
        F.coalesce(F.max("ra"), F.col("a")).alias("root"),
        (F.count(F.when(F.col("ra") == F.col("rb"), 1)) / F.count(F.lit(1))).alias("recall"),
    )
    return each.groupBy("root").agg(F.avg("recall").alias("recall")).agg(F.avg("recall")).first()[0]


def compared(table: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """All connections, from comparing all vectors: the work grows with the square of the table."""
    return first_graph(table, dtype, threshold, 0, 0, tables=1).where("link")


def count_block(key: tuple, group: pd.DataFrame, dtype: str, threshold: float) -> pd.DataFrame:
    """For two blocks of a group, or one: how many vectors, copies counted, each one is linked to."""
    _, x, y = key
    ids, copies, chunk = (group[c].to_numpy() for c in ("id", "copies", "chunk"))
    total = np.zeros(len(ids), dtype=np.int64)
    for at, rows in by_width(group["raw"].tolist(), dtype):
        a, b = (np.arange(len(at)),) * 2 if x == y else (np.flatnonzero(chunk[at] == x), np.flatnonzero(chunk[at] == y))
        linked = rows[a] @ rows[b].T >= threshold
        if x == y:
            np.fill_diagonal(linked, False)
        total[at[a]] += linked @ copies[at[b]]
        if x != y:
            total[at[b]] += linked.T @ copies[at[a]]
    return pd.DataFrame({"id": ids, "n": total})


def enlarged(table: DataFrame, roots: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """Exact numbers of links within each group."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / BLOCK)
    members = roots.join(sizes, "root").withColumns({"chunk": F.pmod(F.xxhash64("id"), chunks), "chunks": chunks})
    loads = members.join(table, "id")
    each = met(loads)

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return count_block(key, group, dtype, threshold)

    pairs = each.select("root", "x", "y", "id", "copies", "chunk", "raw").groupBy("root", "x", "y")
    found = pairs.applyInPandas(count, "id bigint, n bigint")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, least: float = 0.98
) -> DataFrame:
    """One row per vector: ``key``, n_links, component_id, kept.

    Links join vectors with a cosine of ``threshold`` or more in double precision, copies included. Vectors
    that are null, empty, zero or hold a null or not finite component have none; vectors of different lengths
    are never linked. Rows without a key have no link and no component; repeated rows are copies of
    one another. Other columns are ignored, an empty table stays empty. ``least`` is the audited
    recall below which more hyperplanes are added, and after AUDITS audits all vectors are compared. Without any link among
    the vectors asked and those of a fresh search there is nothing to tell a recall from, and the search ends.
    """
    ship_package(df.sparkSession)
    raw, dtype = distinct_vectors(df.select(key, vector), key, vector)
    each = materialize(raw, "vectors")
    table = materialize(each.groupBy("raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "distinct")
    n = table.count()
    grouped, graph = table.withColumn("root", F.col("id")), None
    seed = audits = 0
    while True:
        graph = descended(grouped, dtype, threshold, n, seed, graph)
        roots = groups_of(graph)
        seed += 1
        if not saturated(graph, threshold):
            fresh = materialize(first_graph(grouped, dtype, threshold, n, FRESH + seed), "fresh")
            told = [recaptured(fresh, roots), audit(table, dtype, roots, threshold)]
            if min((r for r in told if r is not None), default=1.0) >= least:
                break
            audits += 1
            graph = graph.unionByName(fresh)
            if audits == AUDITS:
                roots = groups_of(compared(grouped, dtype, threshold))
                break
        grouped = materialize(table.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "grouped")
        graph = outside(graph, roots)
    counts = enlarged(table, roots, dtype, threshold)
    named = table.join(roots, "id", "left").join(counts, "id", "left").select(
        "raw",
        F.coalesce("root", "id").alias("component_id"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    found = each.join(named, "raw").select(F.col("id").alias("__id"), "component_id", "n_links").distinct()
    keyed = df.select(F.col(key).cast("bigint").alias("__key"))
    return keyed.join(found, keyed["__key"] == found["__id"], "left").select(
        F.col("__key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "__key").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "__key") == F.col("__key"), F.lit(True)).alias("kept"),
    )
