"""Positions of rows in a total order, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sinks.scratch import stored


def with_ordinal(rows: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """``rows`` with their position, from 1, in the order of these columns.

    Rows are dealt by ranges of the order and sorted within, and written; a
    row's position is its place in its part plus the rows of the parts before.
    Only a count per part meets in one task. Equal rows are next to each other
    in any order, and in one part: add a key that tells them apart. Pass what
    the order needs and a key, not whole documents.
    """
    dealt = _dealt(rows, order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per part
    joined = dealt.join(F.broadcast(offsets), "_part")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_place") + 1).alias(name))


def with_sum_before(rows: DataFrame, group: str, *order: Column | str, size: str, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``size`` over the rows of their ``group`` that come before them.

    As ``with_ordinal``: sums run within a part, and only a total per part and
    group meets the others of its group, so a group may have any number of rows.
    """
    dealt = _dealt(rows, (group, *order))
    running = F.sum(size).over(Window.partitionBy("_part", group).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    totals = dealt.groupBy("_part", group).agg(F.sum(size).alias("_total"))
    earlier = F.sum("_total").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(F.col("_part").alias("_of"), F.col(group).alias("_group"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    summed = dealt.withColumn("_running", F.coalesce(running, F.lit(0)))
    joined = summed.join(offsets, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_running")).alias(name))


def _dealt(rows: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    """Rows in ranges of the order, with ``_part`` and ``_place``. Both are fixed by
    writing them: another run of the sampling might cut elsewhere."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", place), "dealt")
