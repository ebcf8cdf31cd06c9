"""Queries on board features, moves, losses, paths and replayed games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import board as B
from ..functions import losses as L
from ..functions import moves as M
from ..functions.outcome import outcome_for_mover, result_one_hot
from ..operators.evaluate import LOSSES, evaluate, row_losses
from ..operators.graph import distance_bias, shortest_paths
from ..operators.planes import augment, join_move_planes, plane_moves
from ..operators.replay import replay_games
from ..plans.encode import encode_positions, numbered_plies, spread
from .registry import query, table

RESULT = "CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' ELSE '1/2-1/2' END"


@query("outcome_targets", f"""
SELECT o_orderkey, CAST(r = '1-0' AS BIGINT) AS white, CAST(r = '1/2-1/2' AS BIGINT) AS draw, CAST(r = '0-1' AS BIGINT) AS black,
  CAST(CASE WHEN r = '1/2-1/2' THEN 1 WHEN (r = '1-0') = (o_custkey % 2 = 0) THEN 2 ELSE 0 END AS BIGINT) AS value_target
FROM (SELECT *, {RESULT} AS r FROM orders)""")
def outcome_query(spark, folder):
    status = F.col("o_orderstatus")
    result = F.when(status == "F", "1-0").when(status == "O", "0-1").otherwise("1/2-1/2")
    hot = result_one_hot(result)
    return table(spark, folder, "orders").select(
        "o_orderkey",
        *[hot[i].cast("bigint").alias(n) for i, n in enumerate(("white", "draw", "black"))],
        outcome_for_mover(result, F.col("o_custkey") % 2 == 0).cast("bigint").alias("value_target"),
    )


# A board per document: the first 32 hex digits of its digest become cells of four ranks.
LETTERS = "PNBRQKpnbrqk1111"
DIGITS = "0123456789abcdef"


def boards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    cells = F.translate(F.md5("text"), DIGITS, LETTERS)
    ranks = [F.substring(cells, 1 + 8 * i, 8) for i in range(4)]
    placement = F.concat_ws("/", ranks[0], F.lit("8"), ranks[1], F.lit("2PP4"), ranks[2], F.lit("4pp2"), ranks[3], F.lit("8"))
    # one-cell runs join into the usual digits
    for n in range(8, 1, -1):
        placement = F.regexp_replace(placement, rf"(?<!1)1{{{n}}}(?!1)", str(n))
    fen = F.concat_ws(
        " ", placement,
        F.when(F.col("doc_id") % 2 == 0, "w").otherwise("b"),
        F.when(F.col("doc_id") % 3 == 0, "KQk").when(F.col("doc_id") % 3 == 1, "q").otherwise("-"),
        F.when(F.col("doc_id") % 4 == 0, "e3").when(F.col("doc_id") % 4 == 1, "h6").otherwise("-"),
    )
    return docs.select("doc_id", fen.alias("fen"))


BOARDS = f"""
WITH m AS (SELECT doc_id, translate(md5(text), '{DIGITS}', 'PNBRQKpnbrqk....') AS h FROM documents),
c AS (SELECT doc_id, h[1:8] || '........' || h[9:16] || '..PP....' || h[17:24] || '....pp..' || h[25:32] || '........' AS cells FROM m),
p AS (SELECT doc_id, xor(i - 1, 56) AS sq, instr('PNBRQKpnbrqk', cells[i]) - 1 AS plane
      FROM (SELECT doc_id, cells, unnest(range(1, 65)) AS i FROM c) WHERE cells[i] <> '.'),
bits AS (SELECT doc_id, plane * 64 + sq AS bit FROM p
  UNION ALL SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN [768, 775, 831] WHEN 1 THEN [824] ELSE [] END) FROM documents
  UNION ALL SELECT doc_id, 832 + CASE doc_id % 4 WHEN 0 THEN 20 ELSE 47 END FROM documents WHERE doc_id % 4 < 2)
"""


@query("board_planes", BOARDS + """
SELECT doc_id, array_to_string(list(bit ORDER BY bit), ' ') AS bits FROM bits GROUP BY doc_id""")
def board_planes_query(spark, folder):
    return boards(spark, folder).select("doc_id", F.array_join(B.board_planes("fen").cast("array<string>"), " ").alias("bits"))


@query("dense_planes", BOARDS + """
SELECT doc_id, count(*) AS ones, CAST(sum(bit) AS BIGINT) AS weight, CAST(896 AS BIGINT) AS size FROM bits GROUP BY doc_id""")
def dense_planes(spark, folder):
    dense = boards(spark, folder).select("doc_id", B.to_dense(B.board_planes("fen"), 896).alias("d"))
    back = dense.select("doc_id", F.size("d").cast("bigint").alias("size"), B.to_sparse("d").cast("array<bigint>").alias("s"))
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return back.select("doc_id", F.size("s").cast("bigint").alias("ones"), total.alias("weight"), "size")


@query("material", BOARDS + """
SELECT doc_id, CAST(raw AS BIGINT) AS material_raw, CAST(least(greatest(raw, -5), 5) + 5 AS BIGINT) AS material_category FROM (
  SELECT doc_id, sum([1, 3, 3, 5, 9, 0][plane % 6 + 1] * CASE WHEN plane < 6 THEN 1 ELSE -1 END) AS raw FROM p GROUP BY doc_id)""")
def material_query(spark, folder):
    raw = B.material_balance(B.fen_field("fen", 1))
    return boards(spark, folder).select(
        "doc_id", raw.cast("bigint").alias("material_raw"), B.material_category(raw).cast("bigint").alias("material_category")
    )


@query("flips", BOARDS + """
, k AS (SELECT unnest(['none', 'h', 'v', 'hv']) AS flip, unnest([0, 7, 56, 63]) AS mask),
f AS (SELECT doc_id, flip, CASE WHEN flip IN ('v', 'hv') AND bit < 384 THEN bit + 384 WHEN flip IN ('v', 'hv') AND bit < 768 THEN bit - 384 ELSE bit END AS b, mask FROM bits, k)
SELECT doc_id, flip, array_to_string(list(x ORDER BY x), ' ') AS bits FROM (SELECT doc_id, flip, xor(b, mask) AS x FROM f) GROUP BY ALL""")
def flips_query(spark, folder):
    planes = boards(spark, folder).select("doc_id", B.board_planes("fen").alias("bits"))
    return augment(planes, "bits").select("doc_id", "flip", F.array_join(F.col("bits").cast("array<string>"), " ").alias("bits"))


def line_moves(spark: SparkSession, folder: str) -> DataFrame:
    """A move per order line: squares from the part and supplier keys, a promotion from the line number."""
    items = table(spark, folder, "lineitem")
    promotion = F.when(F.col("l_linenumber") <= 4, F.element_at(F.lit(["n", "b", "R", "q"]), F.col("l_linenumber")))
    return items.select(
        "l_orderkey", "l_linenumber",
        F.pmod("l_partkey", F.lit(64)).cast("int").alias("src"),
        F.pmod(F.col("l_suppkey") * 5 + F.col("l_partkey"), F.lit(64)).cast("int").alias("dst"),
        promotion.alias("promotion"),
    )


MOVES = """
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey % 64 AS s, (l_suppkey * 5 + l_partkey) % 64 AS t,
  CASE WHEN l_linenumber <= 4 THEN ['n', 'b', 'R', 'q'][l_linenumber] END AS promo FROM lineitem),
d AS (SELECT *, t // 8 - s // 8 AS dr, t % 8 - s % 8 AS df FROM m),
x AS (SELECT *, CASE
    WHEN abs(dr) = 2 AND abs(df) = 1 OR abs(dr) = 1 AND abs(df) = 2 THEN
      56 + CASE dr WHEN -2 THEN 0 WHEN -1 THEN 2 WHEN 1 THEN 4 ELSE 6 END + CASE WHEN df > 0 THEN 1 ELSE 0 END
    WHEN s <> t AND (dr = 0 OR df = 0 OR abs(dr) = abs(df)) THEN 7 * CASE
      WHEN dr > 0 AND df = 0 THEN 0 WHEN dr > 0 AND df > 0 THEN 1 WHEN dr = 0 AND df > 0 THEN 2 WHEN dr < 0 AND df > 0 THEN 3
      WHEN dr < 0 AND df = 0 THEN 4 WHEN dr < 0 AND df < 0 THEN 5 WHEN dr = 0 THEN 6 ELSE 7 END + greatest(abs(dr), abs(df)) - 1 END AS base,
  CASE WHEN (s // 8 = 6 AND t // 8 = 7 OR s // 8 = 1 AND t // 8 = 0) AND abs(df) <= 1 AND lower(promo) IN ('n', 'b', 'r')
    THEN 64 + 3 * (instr('nbr', lower(promo)) - 1) + df + 1 END AS under FROM d)
"""


@query("move_planes", MOVES + """
SELECT s AS src, t AS dst, promo AS promotion, CAST(base AS BIGINT) AS base_plane, CAST(coalesce(under, base) AS BIGINT) AS plane,
       CAST(coalesce(under, base) * 64 + s AS BIGINT) AS policy_index, count(*) AS rows FROM x GROUP BY ALL""")
def move_planes_query(spark, folder):
    joined = join_move_planes(line_moves(spark, folder), "src", "dst", "base_plane")
    planes = joined.withColumns(
        {"plane": M.move_plane("src", "dst", "promotion"), "policy_index": M.policy_index("src", "dst", "promotion")}
    )
    keys = [F.col(c).cast("bigint").alias(c) for c in ("src", "dst", "base_plane", "plane", "policy_index")]
    return planes.groupBy(*keys, "promotion").agg(F.count(F.lit(1)).alias("rows"))


@query("plane_inverse", MOVES + """
SELECT CAST(plane AS BIGINT) AS plane, count(*) AS moves, array_to_string(list(s || '-' || t ORDER BY s, t), ' ') AS pairs FROM (
  SELECT DISTINCT s, t, plane FROM (SELECT s, t, base AS plane FROM x UNION ALL SELECT s, t, under FROM x) WHERE plane IS NOT NULL) GROUP BY plane""")
def plane_inverse(spark, folder):
    inverse = plane_moves(line_moves(spark, folder), "src", "dst", "promotion")
    pairs = F.transform("pairs", lambda p: F.concat(p["f"].cast("string"), F.lit("-"), p["t"].cast("string")))
    return inverse.select(
        F.col("plane").cast("bigint").alias("plane"), F.size("pairs").cast("bigint").alias("moves"), F.array_join(pairs, " ").alias("pairs")
    )


@query("legal_masks", MOVES + """
SELECT l_orderkey, array_to_string(list(DISTINCT coalesce(under, base) * 64 + s ORDER BY coalesce(under, base) * 64 + s) FILTER (coalesce(under, base) IS NOT NULL), ' ') AS mask
FROM x GROUP BY l_orderkey HAVING count(coalesce(under, base)) > 0""")
def legal_masks(spark, folder):
    """Orders stand in for positions, their lines for legal moves. An order has a bounded number of lines."""
    moves = line_moves(spark, folder)
    promotes = M.under_promotion_plane("src", "dst", "promotion").isNotNull()
    promotion = F.when(promotes, F.array_position(F.lit(M.PACKED_PROMOTIONS), F.lower("promotion")).cast("int") - 1).otherwise(0)
    coded = moves.withColumn("code", F.col("src") + 64 * F.col("dst") + 4096 * promotion)
    lists = coded.groupBy("l_orderkey").agg(F.collect_set("code").alias("legal"))
    masks = lists.select("l_orderkey", M.legal_mask("legal").alias("mask")).where(F.size("mask") > 0)
    return masks.select("l_orderkey", F.array_join(F.col("mask").cast("array<string>"), " ").alias("mask"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """An embedding's 64 values as logits and a length."""
    vectors = table(spark, folder, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    return vectors.select(
        F.col("vec_id").alias("row_id"), "label",
        F.slice("x", 1, 3).alias("value_logits"),
        F.slice("x", 4, 3).alias("early_value_logits"),
        F.slice("x", 7, 11).alias("material_logits"),
        F.slice("x", 18, 46).alias("policy_logits"),
        (F.element_at("x", 64) * 100).alias("ply_pred"),
    )


def targets(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    cells = F.sequence(F.lit(0), F.lit(45))
    return vectors.select(
        F.col("vec_id").alias("row_id"),
        F.filter(cells, lambda i: (i + F.col("label")) % 3 == 0).alias("legal_mask"),
        F.pmod(F.col("label") * 3 + F.col("vec_id") % 5, F.lit(46)).alias("policy_target"),
        (F.col("label") % 3).alias("value_target"),
        F.pmod(F.col("vec_id"), F.lit(11)).alias("material_category"),
        F.pmod(F.col("vec_id"), F.lit(200)).alias("ply_target"),
        F.when(F.col("vec_id") % 10 == 9, -1).otherwise(F.col("vec_id")).alias("source_index"),
    )


LSE = "(list_max({0}) + ln(list_sum(list_transform({0}, lambda z: exp(z - list_max({0}))))))"
LOSS_ROWS = f"""
WITH e AS (SELECT vec_id AS row_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT row_id, label, x[1:3] AS v, x[4:6] AS a, x[7:17] AS m, x[18:63] AS p, x[64] * 100 AS ply,
  label % 3 AS vt, row_id % 11 AS mt, row_id % 200 AS pt, (label * 3 + row_id % 5) % 46 AS target,
  list_filter(range(46), lambda i: (i + label) % 3 = 0) AS legal FROM e),
q AS (SELECT *, list_transform(legal, lambda i: p[i + 1]) AS lp FROM s),
l AS (SELECT row_id, label,
  CASE WHEN list_contains(legal, target) THEN {LSE.format("lp")} - p[target + 1] ELSE 0.0 END AS policy,
  {LSE.format("v")} - (0.96 * v[vt + 1] + 0.02 * (list_sum(v) - v[vt + 1])) AS value,
  CASE WHEN abs(ply - pt) / 20 <= 0.5 THEN 0.5 * ((ply - pt) / 20) ** 2 ELSE 0.5 * (abs(ply - pt) / 20 - 0.25) END AS moves_left,
  {LSE.format("a")} - (0.96 * a[vt + 1] + 0.02 * (list_sum(a) - a[vt + 1])) AS auxiliary_value,
  {LSE.format("m")} - m[mt + 1] AS material FROM q),
w AS (SELECT *, policy + 2.0 * value + 0.1 * moves_left + 0.5 * auxiliary_value + 0.25 * material AS total,
  policy + 1.6 * value + 0.5 * moves_left AS compare_lc0 FROM l)
"""
WEIGHTS = {"policy": 1.0, "value": 2.0, "moves_left": 0.1, "auxiliary_value": 0.5, "material": 0.25}


@query("row_losses", LOSS_ROWS + f"SELECT row_id, {', '.join(f'round({n}, 6) AS {n}' for n in LOSSES)} FROM w")
def row_losses_query(spark, folder):
    joined = predictions(spark, folder).join(targets(spark, folder), "row_id")
    return row_losses(joined, WEIGHTS).select("row_id", *[F.round(n, 6).alias(n) for n in LOSSES])


@query("evaluate", LOSS_ROWS + f"""
SELECT label::BIGINT AS label, count(*) AS rows, {', '.join(f'round(avg({n}), 6) AS {n}' for n in LOSSES)} FROM w WHERE row_id % 10 <> 9 GROUP BY label""")
def evaluate_query(spark, folder):
    means = evaluate(predictions(spark, folder), targets(spark, folder), ["row_id"], ["label"], WEIGHTS)
    return means.select(F.col("label").cast("bigint").alias("label"), "rows", *[F.round(n, 6).alias(n) for n in LOSSES])


@query("dense_policy_loss", f"""
WITH e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS p, list_transform(range(64), lambda i: CASE WHEN (i + label) % 4 = 0 THEN -1.0 WHEN i % 5 = 0 THEN 0.25 ELSE 0.0 END) AS t FROM embeddings),
k AS (SELECT *, list_filter(range(1, 65), lambda i: t[i] >= 0) AS ok FROM e),
q AS (SELECT *, list_transform(ok, lambda i: p[i]) AS lp, list_transform(ok, lambda i: t[i]) AS lt FROM k)
SELECT row_id, round(list_sum(list_transform(range(1, len(lp) + 1), lambda i: lt[i] * ({LSE.format("lp")} - lp[i]))), 6) AS loss FROM q""")
def dense_policy_query(spark, folder):
    vectors = table(spark, folder, "embeddings")
    wanted = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.when((i + F.col("label")) % 4 == 0, -1.0).when(i % 5 == 0, 0.25).otherwise(0.0),
    )
    return vectors.select(
        F.col("vec_id").alias("row_id"),
        F.round(L.dense_policy_loss("embedding", wanted), 6).alias("loss"),
    )


NATION, SUPPLIER, PART = 0, 1, 2


def node(key: str, kind: int):
    """One id space for three tables."""
    return F.col(key).cast("bigint") * 3 + kind


def supply_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Nations, suppliers and parts as nodes; both directions of each link."""
    suppliers, items = table(spark, folder, "supplier"), table(spark, folder, "lineitem")
    homes = suppliers.select(node("s_nationkey", NATION).alias("a"), node("s_suppkey", SUPPLIER).alias("b"), F.lit(1.0).alias("w"))
    sales = items.select(node("l_suppkey", SUPPLIER).alias("a"), node("l_partkey", PART).alias("b"), (F.col("l_discount") + 1.0).alias("w"))
    both = homes.unionByName(sales)
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return both.select("w", F.inline(ends))


ROUNDS = 7
PATHS = """
WITH one AS (SELECT s_nationkey::BIGINT * 3 AS a, s_suppkey * 3 + 1 AS b, 1.0::DOUBLE AS w FROM supplier
  UNION ALL SELECT l_suppkey * 3 + 1, l_partkey * 3 + 2, l_discount + 1.0 FROM lineitem),
e AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM (SELECT a AS src, b AS dst, w FROM one UNION ALL SELECT b, a, w FROM one) GROUP BY ALL),
d0 AS (SELECT n_nationkey::BIGINT * 3 AS source, n_nationkey::BIGINT * 3 AS node, 0.0::DOUBLE AS dist FROM nation)""" + "".join(
    f""",
d{i} AS MATERIALIZED (SELECT source, node, min(dist) AS dist FROM (SELECT * FROM d{i - 1} UNION ALL
  SELECT source, dst, dist + w FROM d{i - 1} JOIN e ON node = src) GROUP BY ALL)"""
    for i in range(1, ROUNDS + 1)
)


@query("shortest_paths", PATHS + f"""
SELECT source, node, round(dist, 6) AS dist,
  round(CASE WHEN source = node THEN 0.0 ELSE -1 / (1 + exp(-6.0 * least(greatest((dist - 1) / 0.35, 0), 1) + 3.0)) END, 6) AS bias FROM d{ROUNDS}""")
def shortest_paths_query(spark, folder):
    nations = table(spark, folder, "nation").select(node("n_nationkey", NATION).alias("node"))
    paths = shortest_paths(supply_edges(spark, folder), nations)
    bias = distance_bias("dist", F.col("source") == F.col("node"))
    return paths.select("source", "node", F.round("dist", 6).alias("dist"), F.round(bias, 6).alias("bias"))


# Games with captures and castling on both sides, as moves and as squares, and knight tours
# that return to the start position.
OPENINGS = [
    "e4 d5 exd5 Qxd5 Nc3 Qa5 d4 Nf6 Nf3 c6 Bc4 Bf5 Bd2 e6 O-O Be7 Re1 O-O",
    "d4 e6 e4 d5 exd5 exd5 Bd3 Bd6 Ne2 Nc6 c3 Qh4 Nd2 Bg4 Qb3 O-O-O O-O Bxe2 Bxe2 Nge7",
    "c4 e5 Nc3 Nf6 g3 d5 cxd5 Nxd5 Bg2 Nb6 Nf3 Nc6 O-O Be7 d3 O-O Be3 f5",
    "e4 e5 d4 exd4 Qxd4 Nc6 Qe3 Nf6 Nc3 Bb4 Bd2 O-O O-O-O Re8 Bc4 Bxc3 Bxc3 Nxe4",
]
OPENING_SQUARES = [
    "e2e4 d7d5 e4d5 d8d5 b1c3 d5a5 d2d4 g8f6 g1f3 c7c6 f1c4 c8f5 c1d2 e7e6 e1g1 f8e7 f1e1 e8g8",
    "d2d4 e7e6 e2e4 d7d5 e4d5 e6d5 f1d3 f8d6 g1e2 b8c6 c2c3 d8h4 b1d2 c8g4 d1b3 e8c8 e1g1 g4e2 d3e2 g8e7",
    "c2c4 e7e5 b1c3 g8f6 g2g3 d7d5 c4d5 f6d5 f1g2 d5b6 g1f3 b8c6 e1g1 f8e7 d2d3 e8g8 c1e3 f7f5",
    "e2e4 e7e5 d2d4 e5d4 d1d4 b8c6 d4e3 g8f6 b1c3 f8b4 c1d2 e8g8 e1c1 f8e8 f1c4 b4c3 d2c3 f6e4",
]
TOURS = ["Nf3 Nf6 Ng1 Ng8", "Nc3 Nc6 Nb1 Nb8", "Nh3 Nh6 Ng1 Ng8", "Na3 Na6 Nb1 Nb8"]
TOUR_SQUARES = ["g1f3 g8f6 f3g1 f6g8", "b1c3 b8c6 c3b1 c6b8", "g1h3 g8h6 h3g1 h6g8", "b1a3 b8a6 a3b1 a6b8"]
TOUR_COUNT = 6


def turn_games(spark: SparkSession, folder: str) -> DataFrame:
    """A game per conversation turn: knight tours picked by the text's digest, then an opening."""
    turns = table(spark, folder, "conversations")
    digest = F.md5("text")
    picks = [
        F.element_at(F.lit(TOURS), F.pmod(F.conv(F.substring(digest, i, 1), 16, 10).cast("int"), F.lit(4)) + 1)
        for i in range(1, TOUR_COUNT + 1)
    ]
    opening = F.element_at(F.lit(OPENINGS), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)).cast("int") + 1)
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("game_id"),
        F.lit("train").alias("split"),
        F.when(F.col("role") == "user", "lichess").otherwise("lc0").alias("source"),
        F.when(F.col("turn") % 3 == 0, "1-0").when(F.col("turn") % 3 == 1, "0-1").otherwise("1/2-1/2").alias("result"),
        F.split(F.concat_ws(" ", *picks, opening), " ").alias("moves"),
        F.lit(None).cast("string").alias("fen"),
        F.lit(None).cast("string").alias("variant"),
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


START_CELLS = "RNBQKBNRPPPPPPPP" + "." * 32 + "pppppppprnbqkbnr"
# The board is folded ply by ply as text: lift, drop, and the rook's step when a king moves two files.
GAMES = f"""
WITH RECURSIVE g AS (SELECT conv_id || '-' || turn AS game_id, role, turn,
  string_split(array_to_string(list_transform(range(1, {TOUR_COUNT + 1}), lambda i: {_list(TOUR_SQUARES)}[1 + (strpos('{DIGITS}', md5(text)[i]) - 1) % 4]), ' ')
    || ' ' || {_list(OPENING_SQUARES)}[1 + (conv_id + turn) % 4], ' ') AS m FROM conversations),
b AS (SELECT game_id, CAST(0 AS BIGINT) AS ply, '{START_CELLS}' AS cells FROM g
  UNION ALL
  SELECT game_id, ply + 1, CASE WHEN piece IN ('K', 'k') AND abs(s - t) = 2
      THEN CASE WHEN t > s THEN left(moved, t - 1) || moved[t + 2] || moved[t + 1] || '.' || substr(moved, t + 3)
        ELSE left(moved, t - 2) || '.' || moved[t] || moved[t + 1] || moved[t - 1] || substr(moved, t + 3) END ELSE moved END
  FROM (SELECT game_id, ply, s, t, piece, CASE WHEN s < t THEN left(cells, s) || '.' || substr(cells, s + 2, t - s - 1) || piece || substr(cells, t + 2)
      ELSE left(cells, t) || piece || substr(cells, t + 2, s - t - 1) || '.' || substr(cells, s + 2) END AS moved
    FROM (SELECT b.game_id, ply, cells, s, t, cells[s + 1] AS piece FROM b JOIN (SELECT game_id, unnest(range(len(m))) AS k, unnest(m) AS u,
        ascii(u[1]) - 97 + 8 * (u[2]::INT - 1) AS s, ascii(u[3]) - 97 + 8 * (u[4]::INT - 1) AS t FROM g) mv ON mv.game_id = b.game_id AND mv.k = ply))),
plies AS (SELECT g.game_id, role, turn, unnest(range(len(m))) AS ply, unnest(m) AS u, len(m) AS n FROM g),
rows AS (SELECT plies.*, cells, ascii(u[1]) - 97 + 8 * (u[2]::INT - 1) AS s, ascii(u[3]) - 97 + 8 * (u[4]::INT - 1) AS t,
  row_number() OVER (PARTITION BY plies.game_id, cells, plies.ply % 2 ORDER BY plies.ply) - 1 AS seen
  FROM plies JOIN b ON b.game_id = plies.game_id AND b.ply = plies.ply)
"""


@query("replay_games", GAMES + """
SELECT game_id, CAST(ply AS BIGINT) AS ply, CAST(s AS BIGINT) AS move_from, CAST(t AS BIGINT) AS move_to, CAST(seen AS BIGINT) AS rep_count,
  cells[57:64] || cells[49:56] || cells[41:48] || cells[33:40] || cells[25:32] || cells[17:24] || cells[9:16] || cells[1:8] AS board,
  ply % 2 = 0 AS white FROM rows""")
def replay_query(spark, folder):
    plies = replay_games(spread(turn_games(spark, folder)), ["game_id"])
    return plies.select(
        "game_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("ply", "move_from", "move_to", "rep_count")],
        B.expand_placement(B.fen_field("fen", 1)).alias("board"),
        B.white_to_move("fen").alias("white"),
    )


WORTH = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9}
BALANCE = "(" + " + ".join(f"{w} * (length(replace(cells, '{p.lower()}', '')) - length(replace(cells, '{p}', '')))" for p, w in WORTH.items()) + ")"


@query("encode_positions", GAMES + f"""
SELECT game_id, CAST(ply AS BIGINT) AS ply, CASE WHEN role = 'user' THEN 'lichess' ELSE 'lc0' END AS source,
  CAST(length(replace(cells, '.', '')) AS BIGINT) AS pieces, CAST({BALANCE} AS BIGINT) AS material_raw,
  CAST(least(greatest({BALANCE}, -5), 5) + 5 AS BIGINT) AS material_category,
  CAST(CASE WHEN turn % 3 = 2 THEN 1 WHEN (turn % 3 = 0) = (ply % 2 = 0) THEN 2 ELSE 0 END AS BIGINT) AS value_target,
  CAST(least(n - ply - 1, 30) AS BIGINT) AS ply_target, CAST(n AS BIGINT) AS total_plys, ply % 2 = 0 AS side_to_move,
  seen >= 1 AS rep_count_ge1, seen >= 2 AS rep_count_ge2, true AS target_is_legal FROM rows""")
def encode_query(spark, folder):
    positions = encode_positions(replay_games(spread(turn_games(spark, folder)), ["game_id", "split", "source", "result"], "moves", "fen", "variant"), 30)
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    return positions.select(
        "game_id", wide("ply"), "source",
        F.size(F.filter("bitboards", lambda b: b < 768)).cast("bigint").alias("pieces"),
        wide("material_raw"), wide("material_category"), wide("value_target"), wide("ply_target"),
        F.col("total_plys_in_game").cast("bigint").alias("total_plys"),
        "side_to_move", "rep_count_ge1", "rep_count_ge2",
        F.array_contains("legal_mask", F.col("policy_target")).alias("target_is_legal"),
    )


PLIES = 200  # documents that stand for one game


@query("ply_positions", BOARDS + ", mv AS (SELECT doc_id, doc_id % 64 AS s, (doc_id * 5 + doc_id // 64) % 64 AS t, NULL AS promo FROM documents),\n"
  + MOVES[MOVES.index("d AS (") :].replace("FROM m)", "FROM mv)") + f""",
g AS (SELECT doc_id, lang, source || '-' || doc_id // {PLIES} AS game, md5(text) AS board FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY doc_id) - 1 AS ply, count(*) OVER (PARTITION BY game) AS total,
  row_number() OVER (PARTITION BY game, board, doc_id % 12 ORDER BY doc_id) - 1 AS seen FROM g),
w AS (SELECT doc_id, count(*) AS pieces, sum([1, 3, 3, 5, 9, 0][plane % 6 + 1] * CASE WHEN plane < 6 THEN 1 ELSE -1 END) AS raw FROM p GROUP BY doc_id),
f AS (SELECT doc_id, count(*) FILTER (bit >= 768) AS flags FROM bits GROUP BY doc_id)
SELECT doc_id, game AS game_id, CAST(ply AS BIGINT) AS ply, CAST(total AS BIGINT) AS total_plys, CAST(least(total - ply - 1, 30) AS BIGINT) AS ply_target,
  CAST(pieces AS BIGINT) AS pieces, CAST(flags AS BIGINT) AS flags, CAST(raw AS BIGINT) AS material_raw,
  CAST(least(greatest(raw, -5), 5) + 5 AS BIGINT) AS material_category,
  CAST(CASE WHEN lang = 'en' THEN 1 WHEN (lang = 'de') = (doc_id % 2 = 0) THEN 2 ELSE 0 END AS BIGINT) AS value_target,
  doc_id % 2 = 0 AS side_to_move, seen >= 1 AS rep_count_ge1, seen >= 2 AS rep_count_ge2,
  CAST(coalesce(under, base) * 64 + s AS BIGINT) AS policy_target, coalesce(under, base) IS NOT NULL AS target_is_legal
FROM n JOIN w USING (doc_id) JOIN f USING (doc_id) JOIN x USING (doc_id)""")
def ply_positions(spark, folder):
    """Every document as a ply of its source's games: numbers and repetitions by windows, all features native."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source").join(boards(spark, folder), "doc_id")
    src, dst = F.col("doc_id") % 64, (F.col("doc_id") * 5 + F.floor(F.col("doc_id") / 64)) % 64
    plies = docs.select(
        "doc_id", "fen", "source",
        F.concat_ws("-", "source", F.floor(F.col("doc_id") / PLIES).cast("string")).alias("game_id"),
        F.lit("train").alias("split"),
        F.when(F.col("lang") == "de", "1-0").when(F.col("lang") == "en", "1/2-1/2").otherwise("0-1").alias("result"),
        src.cast("int").alias("move_from"), dst.cast("int").alias("move_to"), F.lit(None).cast("string").alias("promotion"),
        F.array((src + 64 * dst).cast("int"), F.lit(12 + 64 * 28)).alias("legal"), F.lit(False).alias("is_960"),
    )
    numbered = numbered_plies(plies, ["doc_id"]).withColumn("game_id", F.concat_ws("#", "game_id", "doc_id"))
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    return encode_positions(numbered, 30).select(
        F.substring_index("game_id", "#", -1).cast("bigint").alias("doc_id"), F.substring_index("game_id", "#", 1).alias("game_id"),
        wide("ply"), F.col("total_plys_in_game").cast("bigint").alias("total_plys"), wide("ply_target"),
        F.size(F.filter("bitboards", lambda b: b < 768)).cast("bigint").alias("pieces"),
        F.size(F.filter("bitboards", lambda b: b >= 768)).cast("bigint").alias("flags"),
        wide("material_raw"), wide("material_category"), wide("value_target"),
        "side_to_move", "rep_count_ge1", "rep_count_ge2", wide("policy_target"),
        F.coalesce(F.array_contains("legal_mask", F.col("policy_target")), F.lit(False)).alias("target_is_legal"),
    )
