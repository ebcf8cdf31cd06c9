"""Shortest paths by repeated joins, and the square graph they are used on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moves import KNIGHT_JUMPS, RAY_DIRECTIONS
from ..session import bucketed, materialize

# Step weights and the bias curve.
KING_STEP = 1.0
KNIGHT_STEP = 1.3
SLIDE_STEP = 0.05
BIAS_RANGE = 0.35
BIAS_SLOPE = 6.0
BIAS_SHIFT = 3.0

PACK = 32  # sources in a row of distances


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, node, dist`` for every node reachable over ``edges(src, dst, w)``, w ≥ 0.

    Up to ``PACK`` sources share a row per node, with a distance for each, so an edge is followed
    once for all of them. A round extends only the distances that improved in the round before, and appends what
    it improves to a log in the shared folder; nothing is written twice. It ends when none improves. Edges are
    stored in buckets by their start, so no round moves them again. A missing weight makes a missing distance,
    longer than any other.
    """
    ids = sources.select(F.col("node").alias("source")).distinct().withColumn("id", F.monotonically_increasing_id())
    # written, so that the ids stay
    packed = materialize(ids.select("source", F.floor(F.col("id") / PACK).alias("pack"), (F.col("id") % PACK).alias("slot")), "sources")
    slots = [f"d{k}" for k in range(min(PACK, packed.count()))]
    if not slots:
        return packed.join(edges, F.lit(False)).select("source", F.coalesce("source", "dst").alias("node"), F.lit(0.0).alias("dist"))
    # parallel edges: the lightest wins; NaN, which Spark orders last, stands for null
    weight = F.coalesce(F.min(F.col("w").cast("double")), F.lit(float("nan")))
    with bucketed(edges.groupBy("src", "dst").agg(weight.alias("w")), "src", "edges") as light:
        starts = [F.when(F.col("slot") == k, 0.0).alias(d) for k, d in enumerate(slots)]
        rounds = [materialize(packed.select("pack", F.col("source").alias("node"), *starts), "paths")]
        while not rounds[-1].isEmpty():
            reached = (
                rounds[-1].join(light, F.col("node") == F.col("src"))
                .groupBy("pack", F.col("dst").alias("node"))
                .agg(*[F.min(F.col(d) + F.col("w")).alias(d) for d in slots])
            )
            known = least_distances(rounds, slots).withColumnsRenamed({d: f"__{d}" for d in slots})
            better = reached.join(known, ["pack", "node"], "left").select(
                "pack", "node", *[F.when(F.col(f"__{d}").isNull() | (F.col(d) < F.col(f"__{d}")), F.col(d)).alias(d) for d in slots]
            )
            rounds.append(materialize(better.where(F.coalesce(*slots).isNotNull()), "paths"))
        names = F.transform(F.array_sort(F.collect_list(F.struct("slot", "source"))), lambda x: x["source"])
        of_packs = packed.groupBy("pack").agg(names.alias("sources"))
        found = least_distances(rounds, slots).join(of_packs, "pack")
        pairs = found.select("node", F.inline(F.arrays_zip("sources", F.array(*slots).alias("dist")))).where("dist IS NOT NULL")
        return pairs.select(F.col("sources").alias("source"), "node", F.when(~F.isnan("dist"), F.col("dist")).alias("dist"))


def least_distances(rounds: list[DataFrame], slots: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, rounds).groupBy("pack", "node").agg(*[F.min(d).alias(d) for d in slots])


def board_edges(spark: SparkSession) -> DataFrame:
    """Lightest king, knight or sliding step between each pair of the 64 squares."""
    kinds = [(dr, df, KING_STEP, 0.0, 1) for dr, df in RAY_DIRECTIONS]
    kinds += [(dr, df, KNIGHT_STEP, 0.0, 1) for dr, df in KNIGHT_JUMPS]
    kinds += [(dr, df, 1.0, SLIDE_STEP, 7) for dr, df in RAY_DIRECTIONS]
    steps = F.array(
        *[F.struct(*[F.lit(v).alias(n) for v, n in zip(kind, ("dr", "df", "base", "per", "most"))]) for kind in kinds]
    )
    moves = (
        spark.range(64)
        .select(F.col("id").cast("int").alias("src"), F.inline(steps))
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.col("most"))))
        .withColumns({"r": F.shiftright("src", 3) + F.col("dr") * F.col("n"), "f": F.pmod("src", F.lit(8)) + F.col("df") * F.col("n")})
        .where(F.col("r").between(0, 7) & F.col("f").between(0, 7))
    )
    weighed = moves.select("src", (F.col("r") * 8 + F.col("f")).alias("dst"), (F.col("base") + F.col("per") * F.col("n")).alias("w"))
    return weighed.groupBy("src", "dst").agg(F.min("w").alias("w"))


def distance_bias(dist, same_node: Column) -> Column:
    """−sigmoid of the rescaled distance, 0 on the diagonal."""
    value = F.col(dist) if isinstance(dist, str) else dist
    scaled = F.least(F.greatest((value - 1.0) / BIAS_RANGE, F.lit(0.0)), F.lit(1.0))
    return F.when(same_node, 0.0).otherwise(-1.0 / (1.0 + F.exp(-BIAS_SLOPE * scaled + BIAS_SHIFT)))


def bias_matrix(paths: DataFrame, nodes: int = 64) -> DataFrame:
    """``(row, column, bias)`` with an extra zero row and column 0."""
    inner = paths.select(
        (F.col("source") + 1).alias("row"),
        (F.col("node") + 1).alias("column"),
        distance_bias("dist", F.col("source") == F.col("node")).alias("bias"),
    )
    edge = paths.sparkSession.range(nodes + 1).select(F.col("id").cast("int").alias("i"))
    border = edge.select(F.lit(0).alias("row"), F.col("i").alias("column"), F.lit(0.0).alias("bias")).union(
        edge.where("i > 0").select("i", F.lit(0), F.lit(0.0))
    )
    return inner.unionByName(border)


def bias_checks(matrix: DataFrame) -> DataFrame:
    """One row: size, symmetry, diagonal and bounds of a bias matrix."""
    mirrored = matrix.select(F.col("column").alias("row"), F.col("row").alias("column"), F.col("bias").alias("other"))
    both = matrix.join(mirrored, ["row", "column"], "left")
    return both.agg(
        F.count(F.lit(1)).alias("cells"),
        F.max(F.abs(F.col("bias") - F.col("other"))).alias("asymmetry"),
        F.max(F.when(F.col("row") == F.col("column"), F.abs("bias"))).alias("diagonal"),
        F.min("bias").alias("lowest"),
        F.max("bias").alias("highest"),
    )
