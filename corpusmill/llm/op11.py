from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op12 import CRC
from .registry import query, table
from .repair import conversation_key, repair_figures


def _add(best: str, cost: str, letter: str) -> str:
    """A state's best string, its cost in six digits before its letters, after one more edit; null stays null."""
    return f"lpad((left({best}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({best}, 7) || '{letter}'"


def _any(states: str, cost: str, letter: str) -> str:
    return "least(" + ", ".join(_add(s, cost, letter) for s in states.split()) + ")"


# The best string of each state (e start, s, u, a) is carried from row to row; then the edits are played back.
SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor({CRC.replace("conv_id::VARCHAR", "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}, 4294967295) % 20 AS fate
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE fate <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM n),
g AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS k, left(lead(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) AS after,
    CASE WHEN shown = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM f),
figures AS (
  SELECT conv_id, max(pos) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (after IS NOT NULL AND k || after NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM figures
  UNION ALL
  SELECT conv_id, i + 1, {_add("e", "3", "D")},
    least({_add("s", "3", "D")}, CASE WHEN free AND k = 's' THEN {_add("e", "late", "K")} END),
    least({_add("u2", "3", "D")}, CASE WHEN free AND k = 'u' THEN {_any("e s a1", "late", "K")} END, CASE WHEN free THEN {_any("e s a1", "2 + late", "R")} END),
    least({_add("a1", "3", "D")}, CASE WHEN free AND k = 'a' THEN {_add("u2", "late", "K")} END, CASE WHEN free THEN {_add("u2", "2 + late", "R")} END)
  FROM (SELECT *, least(u1, {_add("a1", "2", "I")}) AS u2 FROM (SELECT *, least(a, {_add("u1", "2", "I")}) AS a1 FROM (
    SELECT b.*, least(u, {_any("e s a", "2", "I")}) AS u1, g.k, CAST(coalesce(g.fault, '') = 'truncated' AS INT) AS late,
      coalesce(g.fault, '') NOT IN ('blank', 'duplicate') AS free
    FROM best b JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.pos = b.i + 1)))),
ended AS (
  SELECT b.conv_id, least(e, {_add("s", "4", "II")}, {_add("u", "2", "I")}, a) AS whole
  FROM best b JOIN figures c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.rows = b.i),
walk AS (
  SELECT conv_id, substr(whole, 7) AS audit, 0 AS j, CAST(0 AS BIGINT) AS r, 'E' AS st, CAST([] AS VARCHAR[]) AS lines FROM ended
  UNION ALL
  SELECT w.conv_id, audit, j + 1, r + CAST(l <> 'I' AS INT),
    CASE l WHEN 'D' THEN st WHEN 'K' THEN upper(left(g.role, 1)) ELSE upper(left(wanted, 1)) END,
    CASE l WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, wanted || ':') ELSE
      list_append(lines, CASE l WHEN 'K' THEN g.role ELSE wanted END || ':' || g.text) END
  FROM (SELECT *, substr(audit, j + 1, 1) AS l, CASE WHEN st = 'U' THEN 'assistant' ELSE 'user' END AS wanted FROM walk WHERE j < length(audit)) w
  LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.pos = w.r + 1),
played AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS hash FROM walk WHERE j = length(audit))
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(whole, 6)::BIGINT, 0) AS cost,
  coalesce(substr(whole, 7), '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN figures c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended x ON x.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN played y ON y.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or renamed by a checksum of conversation and turn; nulls are one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = turns.withColumn("__fate", fate).where("__fate != 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("__fate") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("__fate") == 1, "").when(F.col("__fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("__fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    ).drop("__copy")


@query("op11_repair", SQL)
def op11_repair(spark, folder):
    """Every conversation after damage: its faults and its cheapest repair."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    names = turns.groupBy(conversation_key("conv_id").alias("__key")).agg(F.first("conv_id").alias("conv_id"))
    found = names.join(repair_figures(damaged(turns)), "__key", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )
