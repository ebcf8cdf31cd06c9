"""Queries on splits, counts, distributions, samples and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import chosen_suffixes
from ..functions.instants import micros
from ..operators.integrity import checksums, shape_report
from ..operators.profile import (
    category_distribution,
    compare_distributions,
    group_totals,
    pace,
    plane_usage,
    progress,
    rollup_totals,
)
from ..operators.sampling import cap_rows, global_shuffle, two_stage_sample
from ..operators.split import hash_split, holdout_files, holdout_shortfall, remaining
from ..session import scratch_path
from ..sources.chunks import diff_manifest, file_manifest, scan_chunks
from ..sources.sinks import manifest_row
from .registry import literals, query, table

SPLIT = f"CASE WHEN right(sha1(text), 2) IN ({literals(chosen_suffixes(0.1, 42, 2))}) THEN 'test' ELSE 'train' END"
WIDE_SPLIT = f"CASE WHEN right(sha1(text), 3) IN ({literals(chosen_suffixes(0.1, 7, 3))}) THEN 'test' ELSE 'train' END"
SHARES = """
SELECT split, source, rows, level, round(rows / total, 6) AS share
FROM (SELECT *, max(CASE WHEN level = 3 THEN rows END) OVER () AS total FROM t)
"""


def split_documents(spark, folder):
    return hash_split(table(spark, folder, "documents"), "text", 0.1, 42, 2)


@query("hash_split", f"SELECT doc_id, {SPLIT} AS split FROM documents")
def hash_split_query(spark, folder):
    return split_documents(spark, folder).select("doc_id", "split")


@query("hash_split_wide", f"SELECT doc_id, {WIDE_SPLIT} AS split FROM documents")
def hash_split_wide(spark, folder):
    """More suffixes than fit a literal list: the broadcast-join form."""
    return hash_split(table(spark, folder, "documents"), "text", 0.1, 7, 3).select("doc_id", "split")


def split_shares(spark, folder, cube=False):
    totals = rollup_totals(split_documents(spark, folder), ["split", "source"], cube)
    # a few rows per source: the grand total sits among them
    grand = F.expr("max(CASE WHEN level = 3 THEN rows END) OVER ()")
    return totals.withColumn("share", F.round(F.col("rows") / grand, 6))


@query("split_rollup", f"""
WITH t AS (SELECT split, source, count(*) AS rows, CAST(grouping(split, source) AS BIGINT) AS level
FROM (SELECT {SPLIT} AS split, source FROM documents) GROUP BY ROLLUP (split, source)) {SHARES}""")
def split_rollup(spark, folder):
    return split_shares(spark, folder)


@query("split_cube", f"""
WITH t AS (SELECT split, source, count(*) AS rows, CAST(grouping(split, source) AS BIGINT) AS level
FROM (SELECT {SPLIT} AS split, source FROM documents) GROUP BY CUBE (split, source)) {SHARES}""")
def split_cube(spark, folder):
    return split_shares(spark, folder, True)


@query("group_totals", f"""
SELECT {SPLIT} AS split, lang, count(*) AS rows, count(DISTINCT source) AS sources, count(DISTINCT n_chars) AS lengths
FROM documents GROUP BY ALL""")
def group_totals_query(spark, folder):
    return group_totals(split_documents(spark, folder), ["split", "lang"], {"sources": "source", "lengths": "n_chars"})


def _chunked(spark, folder):
    docs = split_documents(spark, folder)
    return docs.select(
        "split",
        F.when(F.col("lang") == "en", "lichess").otherwise("lc0").alias("source"),
        F.floor(F.col("n_chars") / 500).cast("bigint").alias("chunk_id"),
    )


@query("manifest_pivot", f"""
WITH d AS (SELECT {SPLIT} AS split, CASE WHEN lang = 'en' THEN 'lichess' ELSE 'lc0' END AS source, n_chars // 500 AS c FROM documents)
SELECT {", ".join(f"count(*) FILTER (split = '{b}' AND source = '{a}') AS total_{a}_{b}_positions, count(DISTINCT c) FILTER (split = '{b}' AND source = '{a}') AS {a}_{b}_chunks" for b in ("train", "test") for a in ("lichess", "lc0"))},
CAST(500 AS BIGINT) AS chunk_size FROM d""")
def manifest_pivot(spark, folder):
    row = manifest_row(_chunked(spark, folder), params={"chunk_size": 500})
    return row.withColumn("chunk_size", F.col("chunk_size").cast("bigint"))


@query("category_distribution", """
WITH j AS (SELECT lang, quality + toxic AS c FROM labels JOIN documents USING (doc_id)),
l AS (SELECT * FROM (VALUES (0, 'Loss'), (1, 'Draw'), (2, 'Win')) v(code, category))
SELECT lang, CAST(code AS BIGINT) AS code, category, count(*) FILTER (c = code) AS rows,
       round(count(*) FILTER (c = code) / count(*), 6) AS share
FROM j, l GROUP BY ALL""")
def category_distribution_query(spark, folder):
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    classed = joined.withColumn("c", F.col("quality") + F.col("toxic"))
    shares = category_distribution(classed, "c", ("Loss", "Draw", "Win"), ["lang"])
    return shares.withColumn("share", F.round("share", 6))


@query("plane_usage_dense", """
WITH u AS (SELECT unnest(range(64)) AS plane, unnest(embedding) AS x FROM embeddings),
s AS (SELECT plane, sum(abs(CAST(x AS DOUBLE))) AS usage FROM u GROUP BY plane)
SELECT CAST(p.range AS BIGINT) AS plane, round(coalesce(usage, 0), 6) AS usage,
       round(coalesce(usage, 0) / sum(usage) OVER (), 6) AS share
FROM range(73) p LEFT JOIN s ON s.plane = p.range""")
def plane_usage_dense(spark, folder):
    planes = table(spark, folder, "embeddings").withColumn(
        "p", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x))
    )
    return _rounded(plane_usage(planes, "p", 73, "dense"))


@query("plane_usage_index", """
WITH s AS (SELECT (l_partkey * 7 + l_linenumber) % 4672 // 64 AS plane, count(*) AS usage FROM lineitem GROUP BY ALL)
SELECT CAST(p.range AS BIGINT) AS plane, CAST(coalesce(usage, 0) AS DOUBLE) AS usage,
       round(coalesce(usage, 0) / sum(usage) OVER (), 6) AS share
FROM range(73) p LEFT JOIN s ON s.plane = p.range""")
def plane_usage_index(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("i", F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(4672)))
    return _rounded(plane_usage(items, "i", 73))


def _rounded(df):
    return df.select("plane", F.round("usage", 6).alias("usage"), F.round("share", 6).alias("share"))


@query("compare_distributions", f"""
WITH j AS (SELECT {SPLIT} AS split, lang AS category FROM documents),
a AS (SELECT category, count(*) / sum(count(*)) OVER () AS s FROM j WHERE split = 'test' GROUP BY ALL),
b AS (SELECT category, count(*) / sum(count(*)) OVER () AS s FROM j WHERE split = 'train' GROUP BY ALL)
SELECT category, round(coalesce(a.s, 0), 6) AS share_a, round(coalesce(b.s, 0), 6) AS share_b,
       round(coalesce(a.s, 0) - coalesce(b.s, 0), 6) AS difference
FROM a FULL JOIN b USING (category)""")
def compare_query(spark, folder):
    docs = split_documents(spark, folder)

    def shares(side):
        counts = docs.where(F.col("split") == side).groupBy(F.col("lang").alias("category")).count()
        # one row per language
        return counts.select("category", (F.col("count") / F.expr("sum(count) OVER ()")).alias("share"))

    both = compare_distributions(shares("test"), shares("train"), "category")
    return both.select("category", *[F.round(c, 6).alias(c) for c in ("share_a", "share_b", "difference")])


HELD = "md5('42|' || doc_id)"


@query("holdout_files", f"""
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {HELD}, doc_id) <= 5 THEN 'test' ELSE 'train' END AS split
FROM documents""")
def holdout_query(spark, folder):
    return holdout_files(table(spark, folder, "documents"), 5, ["source"], 42, "doc_id").select("doc_id", "split")


@query("holdout_remaining", f"""
SELECT source, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY {HELD}, doc_id) AS rn FROM documents) WHERE rn > 5 GROUP BY source""")
def holdout_remaining(spark, folder):
    docs = table(spark, folder, "documents")
    held = holdout_files(docs, 5, ["source"], 42, "doc_id").where(F.col("split") == "test")
    left = remaining(docs, held, "doc_id")
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


@query("holdout_shortfall", """
SELECT source, lang, count(*) AS available FROM documents GROUP BY ALL HAVING count(*) < 20""")
def shortfall_query(spark, folder):
    return holdout_shortfall(table(spark, folder, "documents"), 20, ["source", "lang"])


DRAWS = """
WITH c AS (SELECT o_orderpriority AS f, count(*) AS n FROM orders GROUP BY ALL),
files AS (SELECT *, row_number() OVER (ORDER BY f) - 1 AS ordinal FROM c),
numbered AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos,
             row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS gpos FROM orders),
draws AS (SELECT i AS draw_id, ('0x' || substr(md5('9|' || i || '|f'), 1, 15))::BIGINT AS fh, ('0x' || substr(md5('9|' || i || '|r'), 1, 15))::BIGINT AS rh FROM range(2000) r(i))
"""


@query("two_stage_sample", DRAWS + """
SELECT draw_id, o_orderkey, o_orderpriority FROM draws JOIN files ON ordinal = fh % (SELECT count(*) FROM files)
JOIN numbered ON o_orderpriority = f AND pos = rh % n""")
def two_stage_query(spark, folder):
    sample = two_stage_sample(table(spark, folder, "orders"), "o_orderpriority", ["o_orderkey"], 2000, 9)
    return sample.select("draw_id", "o_orderkey", "o_orderpriority")


@query("uniform_sample", DRAWS + """
SELECT draw_id, o_orderkey, o_orderpriority FROM draws JOIN numbered ON gpos = rh % (SELECT count(*) FROM orders)""")
def uniform_query(spark, folder):
    sample = two_stage_sample(table(spark, folder, "orders"), "o_orderpriority", ["o_orderkey"], 2000, 9, "uniform")
    return sample.select("draw_id", "o_orderkey", "o_orderpriority")


@query("cap_rows", """
WITH c AS (SELECT o_custkey AS f, count(*) AS n, sum(count(*)) OVER (ORDER BY o_custkey) AS upto FROM orders GROUP BY o_custkey),
r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('3|' || o_orderkey)) AS rn FROM orders)
SELECT o_orderkey, o_custkey FROM r JOIN c ON f = o_custkey WHERE upto <= 1203 OR rn <= 1203 - (upto - n)""")
def cap_query(spark, folder):
    return cap_rows(table(spark, folder, "orders"), "o_custkey", ["o_orderkey"], 1203, 3).select("o_orderkey", "o_custkey")


@query("checksums", """
SELECT count(*) AS rows, round(sum(l_quantity), 4) AS sum_l_quantity, round(sum(l_extendedprice), 2) AS sum_l_extendedprice,
       sum(l_orderkey)::DOUBLE AS sum_l_orderkey, true AS same FROM lineitem""")
def checksum_query(spark, folder):
    items = table(spark, folder, "lineitem")
    before = checksums(items)
    after = checksums(global_shuffle(items, ["l_orderkey", "l_partkey", "l_linenumber"], 5))
    # two one-row tables
    both = before.join(after.select(F.col("rows").alias("r"), F.col("row_hash").alias("h")), F.col("rows") == F.col("r"))
    return both.select(
        "rows", F.round("sum_l_quantity", 4).alias("sum_l_quantity"), F.round("sum_l_extendedprice", 2).alias("sum_l_extendedprice"),
        "sum_l_orderkey", (F.col("row_hash") == F.col("h")).alias("same"),
    )


@query("shape_report", """
SELECT label::BIGINT AS label, count(*) AS rows, min(len(embedding))::BIGINT AS min_embedding, max(len(embedding))::BIGINT AS max_embedding,
       min(len(embedding[1:label + vec_id % 2]))::BIGINT AS min_part, max(len(embedding[1:label + vec_id % 2]))::BIGINT AS max_part,
       min(len(embedding)) = max(len(embedding)) AND min(len(embedding[1:label + vec_id % 2])) = max(len(embedding[1:label + vec_id % 2])) AS uniform
FROM embeddings GROUP BY label""")
def shape_query(spark, folder):
    vectors = table(spark, folder, "embeddings")
    vectors = vectors.withColumn("part", F.slice("embedding", F.lit(1), (F.col("label") + F.col("vec_id") % 2).cast("int")))
    report = shape_report(vectors, ["embedding", "part"], ["label"])
    return report.select(*[F.col(c).cast("bigint").alias(c) if c != "uniform" else F.col(c) for c in report.columns])


@query("file_manifest", """
SELECT o_orderpriority AS folder, count(*) AS rows FROM orders GROUP BY ALL""")
def manifest_query(spark, folder):
    path = scratch_path(spark, "files")
    table(spark, folder, "orders").write.partitionBy("o_orderpriority").parquet(path)
    manifest = file_manifest(spark.read.parquet(path))
    name = F.url_decode(F.regexp_extract("path", "o_orderpriority=([^/]+)/", 1))
    return manifest.groupBy(name.alias("folder")).agg(F.sum("rows").alias("rows"))


@query("manifest_diff", """
SELECT coalesce(o.p_partkey, n.p_partkey) AS path, round(o.p_retailprice, 2) AS old_stamp, round(n.stamp, 2) AS new_stamp,
  CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.p_retailprice = n.stamp THEN 'same' ELSE 'changed' END AS status
FROM (SELECT * FROM part WHERE p_brand <> 'Brand#1') o
FULL JOIN (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice + 1 ELSE p_retailprice END AS stamp FROM part WHERE p_type <> 'SMALL') n
ON o.p_partkey = n.p_partkey""")
def diff_query(spark, folder):
    parts = table(spark, folder, "part")
    old = parts.where(F.col("p_brand") != "Brand#1")
    stamp = F.when(F.col("p_size") > 25, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    new = parts.where(F.col("p_type") != "SMALL").withColumn("p_retailprice", stamp)
    diff = diff_manifest(old, new, "p_partkey", "p_retailprice")
    return diff.select("path", F.round("old_stamp", 2).alias("old_stamp"), F.round("new_stamp", 2).alias("new_stamp"), "status")


@query("chunk_scan", "SELECT doc_id, quality::BIGINT AS quality FROM labels")
def chunk_scan_query(spark, folder):
    whole, partial = scratch_path(spark, "whole"), scratch_path(spark, "partial")
    labels = table(spark, folder, "labels")
    labels.write.parquet(whole)
    labels.drop("quality").write.parquet(partial)
    rows, _ = scan_chunks(spark, [whole, partial], ["doc_id", "quality"])
    return rows.select("doc_id", F.col("quality").cast("bigint").alias("quality"))


@query("progress", """
WITH e AS (SELECT event_id, event_id + 1 AS step, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS elapsed, count(*) OVER () AS n FROM events)
SELECT event_id, round(step * 100.0 / n, 6) AS progress_pct,
       CASE WHEN elapsed > 0 THEN round((n - step) * elapsed / step, 3) END AS eta_seconds FROM e""")
def progress_query(spark, folder):
    events = table(spark, folder, "events")
    elapsed = (micros(events, "ts") - F.unix_micros(F.lit("2024-01-01T00:00:00Z").cast("timestamp"))) / 1e6
    steps = events.withColumns({"step": F.col("event_id") + 1, "elapsed": elapsed})
    done = progress(steps, "step", "elapsed", events.count())
    return done.select("event_id", F.round("progress_pct", 6).alias("progress_pct"), F.round("eta_seconds", 3).alias("eta_seconds"))


@query("pace", """
WITH r AS (SELECT event_type, count(*) AS rows, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds,
  count(DISTINCT user_id) AS workers, count(DISTINCT CAST(ts AS DATE)) AS files FROM events GROUP BY ALL)
SELECT event_type, round(rows / seconds, 9) AS rows_per_second, round(rows / (seconds * workers), 9) AS rows_per_worker_second,
       round(rows / files, 6) AS rows_per_file FROM r""")
def pace_query(spark, folder):
    """Event types as runs, users as workers, days as files."""
    events = table(spark, folder, "events")
    at = micros(events, "ts")
    runs = events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), ((F.max(at) - F.min(at)) / 1e6).alias("seconds"),
        F.count_distinct("user_id").alias("workers"), F.count_distinct(F.col("ts").cast("date")).alias("files"),
    )
    paced = pace(runs, "rows", "seconds", "workers", "files")
    return paced.select(
        "event_type", F.round("rows_per_second", 9).alias("rows_per_second"),
        F.round("rows_per_worker_second", 9).alias("rows_per_worker_second"), F.round("rows_per_file", 6).alias("rows_per_file"),
    )
