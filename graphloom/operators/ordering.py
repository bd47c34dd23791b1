"""A total order over a whole table, and neighbours in it, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpoint

_ROW_BITS = 33  # monotonically_increasing_id keeps the row of a partition in so many low bits


def globally_ranked(df: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the order of ``keys`` over all rows.

    Rows are range-partitioned and sorted, and the partitions' sizes give each one its first number, so a group
    may be any size. Only one count per partition reaches the driver. Rows equal in ``keys`` get numbers in any
    order; nulls come first. An empty table stays empty.
    """
    ordered = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    raw = ordered.withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(F.col(name), _ROW_BITS)
    counts = sorted(raw.groupBy(part.alias("part")).count().collect())
    sizes = {row["part"]: row["count"] for row in counts}
    starts, total = [], 0
    for part_id in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(part_id, 0)
    offsets = F.lit(starts).cast("array<bigint>")
    return raw.withColumn(name, offsets[part.cast("int")] + F.col(name).bitwiseAND((1 << _ROW_BITS) - 1))


def running_totals(df: DataFrame, keys: Sequence[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over all rows before, in the order of ``keys``, which tell rows apart.

    Rows are range-partitioned and sorted as in ``globally_ranked``; one sum per partition reaches the driver, and each
    partition adds up its own rows.
    """
    part = F.shiftright(F.monotonically_increasing_id(), _ROW_BITS).cast("int")
    ordered = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_part", part)
    sums = {row["_part"]: row["total"] for row in ordered.groupBy("_part").agg(F.sum(weight).alias("total")).collect()}
    starts, total = [], 0
    for part_id in range(max(sums, default=0) + 1):
        starts.append(total)
        total += sums.get(part_id) or 0
    earlier = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(weight).over(earlier), F.lit(0))
    return ordered.withColumn(name, F.lit(starts).cast("array<bigint>")[F.col("_part")] + inside).drop("_part")


def ranked_within(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the order of ``order`` within ``group``, which may be of any size."""
    ranked = globally_ranked(df, [group, *order], "_rank")
    first = ranked.groupBy(group).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, group).withColumn(name, F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def with_neighbours(df: DataFrame, group: str, order: Sequence[str], key: str) -> DataFrame:
    """``df`` with ``previous`` and ``following``: ``key`` of the rows before and after within ``group`` by ``order``.

    Null at the ends of a group. Joins on consecutive ranks, so no group is gathered in one task.
    """
    ranked = globally_ranked(df, [group, *order], "_rank")
    side = ranked.select("_rank", F.col(group).alias("_group"), F.col(key).alias("_key"))
    for column, step in (("previous", 1), ("following", -1)):
        near = side.select((F.col("_rank") + step).alias("_rank"), F.col("_group").alias("_near_group"), F.col("_key").alias("_near_key"))
        ranked = ranked.join(near, "_rank", "left").withColumn(column, F.when(F.col("_near_group").eqNullSafe(F.col(group)), F.col("_near_key"))).drop("_near_group", "_near_key")
    return ranked.drop("_rank")
