"""Sorted positions inside groups of any size, without sorting a group in one task.

Rows are range-partitioned and sorted over the group and order columns together, so a hot group spans many partitions.
The slice is written once; a row's position is its place in its partition plus the number of its group's rows in the
partitions before, for which one row per group and partition is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def with_position(df: DataFrame, group: list[str], order: list[Column], name: str = "position", size: str | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in its group; ties get an arbitrary but fixed order. With ``size`` also
    the number of rows of the group.

    Null group values form a group. The result reads a checkpoint, so it is the same however often it is computed.
    """
    groups = [F.col(g) for g in group]
    width = 1 << 33
    sliced = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    row = F.monotonically_increasing_id()
    held = cut_lineage(sliced.withColumn("_row", row).withColumn("_slice", F.shiftright("_row", 33).cast("int")))
    counts = held.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(Window.partitionBy(*group))
    starts = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_slice").alias("_s"), F.pmod("_first", F.lit(width)).alias("_at"), before.alias("_before"), whole.alias("_whole"))
    same = F.col("_slice") == F.col("_s")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return held.join(starts, same).select(*df.columns, (F.pmod("_row", F.lit(width)) - F.col("_at") + F.col("_before")).alias(name), *([F.col("_whole").alias(size)] if size else []))


def carry_last(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` of its group at or before each row in ``order``, as ``name``.

    Like :func:`with_position`, the carry has two levels, so that a hot group is no single task: inside a slice of the
    range-partitioned rows, and between slices over one row for each group and slice.
    """
    c = F.col
    keys = [c(g) for g in (*group, *order)]
    # Rows that are alike in group and order meet in one slice; those with a value come first.
    sliced = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = cut_lineage(sliced.withColumn("_slice", F.spark_partition_id()))
    ends = held.filter(c(value).isNotNull()).groupBy(*group, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    slices = held.select(*group, "_slice").distinct().join(ends, [*group, "_slice"], "left")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(*[c(g).alias(f"_g_{g}") for g in group], c("_slice").alias("_s"), before.alias("_before"))
    same = c("_slice") == c("_s")
    for g in group:
        same = same & c(g).eqNullSafe(c(f"_g_{g}"))
    inside = Window.partitionBy("_slice", *group).orderBy(*order, c(value).isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.coalesce(F.last(value, ignorenulls=True).over(inside), c("_before"))
    return held.join(slices, same).select(*df.columns, carried.alias(name))
