"""The move table as a dimension, and its inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.board import flip
from ..functions.moves import base_plane, under_promotion_plane


def move_planes(spark: SparkSession) -> DataFrame:
    """``from_sq, to_sq, plane``: the 1,792 pairs a piece can move between."""
    pairs = spark.range(64 * 64).select(
        F.floor(F.col("id") / 64).cast("int").alias("from_sq"), F.pmod("id", F.lit(64)).cast("int").alias("to_sq")
    )
    return pairs.withColumn("plane", base_plane("from_sq", "to_sq")).where(F.col("plane").isNotNull())


def join_move_planes(df: DataFrame, src: str, dst: str, out: str = "plane") -> DataFrame:
    """Plane by lookup; NULL where the pair has none. The table has 1,792 rows."""
    table = move_planes(df.sparkSession).select(F.col("from_sq").alias(src), F.col("to_sq").alias(dst), F.col("plane").alias(out))
    return df.join(F.broadcast(table), [src, dst], "left")


def plane_moves(moves: DataFrame, src: str, dst: str, promotion: str) -> DataFrame:
    """Per plane the distinct ``(from, to)`` pairs, under-promotions included, sorted."""
    both = F.array(base_plane(src, dst), under_promotion_plane(src, dst, promotion))
    pairs = moves.select(F.col(src).cast("int").alias("f"), F.col(dst).cast("int").alias("t"), F.explode(both).alias("plane"))
    distinct = pairs.where(F.col("plane").isNotNull()).distinct()
    # at most 64 * 64 pairs per plane
    return distinct.groupBy("plane").agg(F.array_sort(F.collect_set(F.struct("f", "t"))).alias("pairs"))


def augment(df: DataFrame, bits: str, kinds=("h", "v", "hv"), out: str = "flip") -> DataFrame:
    """The original planes and one mirrored copy per kind."""
    copies = [F.struct(F.lit("none").alias(out), F.col(bits).alias("__bits"))]
    copies += [F.struct(F.lit(kind).alias(out), flip(bits, kind).alias("__bits")) for kind in kinds]
    return df.select("*", F.inline(F.array(*copies))).drop(bits).withColumnRenamed("__bits", bits)
