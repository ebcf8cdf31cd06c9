from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.groups import HOT_ROWS, ranked
from ..session import materialize
from .registry import query, table
from .trie import prefix_trie

#: Conversations that share their first turns, and how many turns they share at most.
SHARE, MOST = 20, 3

# The checksum of a decimal number, bit by bit: each character is followed by seven empty steps.
CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda ch: [ascii(ch)::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT]))),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1)))"""

SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n, xor({CRC}, 4294967295) % 4 AS h FROM own GROUP BY conv_id),
sized AS (
  SELECT c.conv_id, c.n, c.h, least(c.h, coalesce(b.n, 0)) AS taken
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % {SHARE}),
turns AS (
  SELECT s.conv_id, o.pos AS d, o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.conv_id - s.conv_id % {SHARE} AND o.pos <= s.h
  UNION ALL SELECT s.conv_id, o.pos - s.h + s.taken, o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.conv_id AND o.pos > s.h),
paths AS (
  SELECT conv_id, d, text, string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM turns
  UNION ALL SELECT conv_id, 0, '', '' FROM convs),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY d, prefix) AS node FROM paths),
nodes AS (
  SELECT node, d, count(*) AS n_convs,
    (count(*) - 1) * max(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS saved
  FROM named GROUP BY node, d),
edges AS (
  SELECT n.node, n.d, n.n_convs, n.saved, up.node AS parent
  FROM nodes n LEFT JOIN named up ON up.conv_id = n.node AND up.d = n.d - 1),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM edges WHERE d > 0 GROUP BY ALL),
marked AS (SELECT e.*, coalesce(c.n_children, 0) AS n_children FROM edges e LEFT JOIN children c USING (node, d)),
sums AS (
  SELECT above.node, above.d, count(*) FILTER (m.n_children = 0) AS n_leaves, sum(m.saved) AS saved_tokens
  FROM marked m JOIN named above ON above.conv_id = m.node AND above.d <= m.d GROUP BY above.node, above.d),
lengths AS (SELECT conv_id, max(d) AS d FROM paths GROUP BY conv_id),
ends AS (
  SELECT node, d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM lengths JOIN named USING (conv_id, d) GROUP BY node, d)
SELECT m.node AS conv_id, m.d::BIGINT AS depth, m.parent AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM marked m JOIN sums s USING (node, d) LEFT JOIN ends e USING (node, d)
"""


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST + 1)


def rebuilt(turns: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(turns with their depth, lengths) after each conversation's first turns are those of another.

    Rows of one turn are ordered by role and text; rows without conversation id belong to none and are left out.
    The remainder of a negative id is negative, as in SQL.
    """
    empty = F.lit("")
    plain = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    own = materialize(ranked(plain, ["conv_id"], ["turn", "role", "text"], "pos", hot_rows=hot_rows).drop("turn"), "turns")
    sizes = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.withColumns({"h": shared_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % SHARE}).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = materialize(convs.withColumn("taken", taken), "conversations")
    heads = own.where(F.col("pos") <= MOST).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base")
    heads = heads.where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "role", "text")
    short = convs.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("less"))
    rest = own.where(F.col("pos") > shared_turns(F.col("conv_id"))).join(short, "conv_id", "left")
    rest = rest.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("depth"), "role", "text")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return heads.unionByName(rest), convs.select("conv_id", length.alias("length"))


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark, folder):
    """All nodes of the trie of the rebuilt conversations."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(*rebuilt(turns))
