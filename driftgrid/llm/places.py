"""Places in ordered groups of any size.

A group may hold most of the table, so no window runs over a whole group: a
range shuffle deals sorted rows to partitions of equal size, each row counts
what comes before it in its own partition, and one small row per group and
partition carries what the partitions before hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.scale import durable


def before(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, amount: str | Column | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` (default: the number) of the rows before it in its group.

    ``group`` columns must not be null; ``order`` (ascending, nulls first) must tell all rows of a group apart, or
    rows must be interchangeable where it does not. The laid out rows are stored, so repeated tasks agree.
    """
    group, order = list(group), list(order)
    amount = F.lit(1).cast("long") if amount is None else F.col(amount) if isinstance(amount, str) else amount
    laid = durable(rows.repartitionByRange(*group, *order).withColumn("part_", F.spark_partition_id()))
    held = laid.groupBy("part_", *group).agg(F.sum(amount).alias("held_"))
    earlier = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = durable(held.select("part_", *group, F.coalesce(F.sum("held_").over(earlier), F.lit(0)).alias("base_")))
    own = Window.partitionBy("part_", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("own_", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return placed.join(base, ["part_", *group]).withColumn(name, F.col("base_") + F.col("own_")).drop("part_", "base_", "own_")
