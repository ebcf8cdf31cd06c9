"""Rows in seeded random order, dealt straight to the partitions that hold their chunks.

The order is that of md5(seed|key). Rows are counted per leading digits of the hash, which tells the place of
every bucket in its group; where a border between partitions falls into a bucket, the hash at the border is looked
up among that bucket's hashes. So each row's partition is known before it is moved, and it is moved once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..session import materialize
from .index import attach

#: Rows of a partition are counted in the low bits of Spark's increasing ids.
LOW_BITS = (1 << 33) - 1


#: Most rows of the table that tells each row its partition; it is sent to all executors.
SLOTS = 1_000_000


class RepeatedKeys(ValueError):
    """Rows of one key lie on both sides of a border between partitions."""


class ManyGroups(ValueError):
    """The places of all groups are too many for a table that every executor gets."""


def _digits(partitions: int) -> int:
    digits = 1
    while 16**digits < partitions and digits < 5:
        digits += 1
    return digits


def _groups(counts: DataFrame, by: Sequence[str], size: int, partitions: int) -> DataFrame:
    """Rows, first chunk and first and last partition of each group, and the number of all chunks; one row per group."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total")).withColumn("chunks", F.ceil(F.col("total") / size))
    every = Window.orderBy(*by, F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per group
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumns({"first_chunk": F.coalesce(F.sum("chunks").over(before), F.lit(0)), "every": F.sum("chunks").over(every)})
    place = lambda chunk: F.floor(chunk * partitions / F.col("every")).cast("bigint")
    last = F.col("first_chunk") + F.col("chunks") - 1
    return placed.withColumns({"p0": place(F.col("first_chunk")), "p1": place(last)})


def placed_chunks(df: DataFrame, size: int, key: Sequence[str], seed: int, by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``row_index`` and ``chunk_id``, sorted, every chunk whole in one partition: one exchange of the rows.

    ``row_index`` is dense from 0 per group of ``by`` in the order of md5(seed|key). The key must tell rows apart at least
    where two partitions meet, else ``RepeatedKeys`` is raised; ``ManyGroups`` if there are more than ``SLOTS`` places, 16 per
    partition and group at most. ``df`` is read three times, twice for its keys only.
    """
    by, names = list(by), df.columns
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn("__h", seeded_hash(seed, *key)).withColumn("__b", F.substring("__h", 1, _digits(partitions)))
    counts = materialize(hashed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("n")), "counts")
    if counts.count() > SLOTS:
        raise ManyGroups(f"more than {SLOTS} places")
    counts = counts.coalesce(1)  # few rows: what follows from them needs no exchange
    groups = _groups(counts, by, size, partitions)

    # the first place of each partition in each group: at most one row per partition and group
    p = F.explode(F.sequence("p0", "p1")).alias("p")
    first = F.greatest(F.lit(0), F.ceil(F.col("p") * F.col("every") / partitions) - F.col("first_chunk"))
    parts = groups.select(*by, "total", "first_chunk", "every", p).withColumn("start", (first * size).cast("bigint"))
    following = F.lead("start").over(Window.partitionBy(*by).orderBy("p"))
    parts = parts.withColumn("rows", F.coalesce(following, "total") - F.col("start")).where("rows > 0")
    earlier = Window.partitionBy("p").orderBy(*by, F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.col("start") - F.coalesce(F.sum("rows").over(earlier), F.lit(0)))

    # buckets in which a partition begins, and the hash of the row it begins with
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = parts.select(*by, "p", "start")
    begins = attach(slots, starts, by).where("start > before AND start < before + n")
    begins = begins.select(*by, "__b", "before", "p", "start")  # one row per partition at most
    inside = hashed.select(*by, "__b", "__h")
    within = attach(inside, F.broadcast(begins.select(*by, "__b", "before").distinct()), [*by, "__b"])
    order = Window.partitionBy(*by, "__b").orderBy("__h")
    ranked = within.withColumns({"at": F.col("before") + F.row_number().over(order) - 1, "same": F.lag("__h").over(order).eqNullSafe(F.col("__h"))})
    borders = attach(ranked, F.broadcast(begins.select(*by, "__b", "p", F.col("start").alias("at"))), [*by, "__b", "at"])
    borders = materialize(borders.select(*by, "__b", "p", "__h", "same"), "borders").coalesce(1)
    if not borders.where("same").isEmpty():
        raise RepeatedKeys("the key repeats where two partitions meet")

    # per bucket: the partition that it begins in, and the hashes from which later ones go on
    cuts = borders.groupBy(*by, "__b").agg(F.array_sort(F.collect_list(F.struct("__h", "p"))).alias("cuts"))
    covering = attach(slots, parts.select(*by, "p", "start", "rows"), by).where("start <= before AND before < start + rows")
    # 16 ** digits rows per group at most, fewer than 16 per partition
    table = attach(covering.select(*by, "__b", "p"), cuts, [*by, "__b"], "left")
    located = attach(hashed, F.broadcast(table), [*by, "__b"])
    passed = F.filter(F.coalesce("cuts", F.array().cast("array<struct<__h:string,p:bigint>>")), lambda c: c["__h"] <= F.col("__h"))
    located = located.withColumn("__p", F.when(F.size(passed) > 0, F.element_at(passed, -1)["p"]).otherwise(F.col("p")))
    moved = located.select(*names, "__h", "__p").repartitionById(partitions, F.col("__p").cast("int")).sortWithinPartitions(*by, "__h")
    counted = moved.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_BITS)))
    bases = parts.select(*by, F.col("p").alias("__p"), "base")
    numbered = attach(counted, F.broadcast(bases), [*by, "__p"])
    index = (F.col("base") + F.col("__at")).cast("bigint")
    return numbered.select(*names, index.alias("row_index"), F.floor(index / size).cast("bigint").alias("chunk_id"))
