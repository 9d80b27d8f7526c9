"""Dense numbers in a given order, without a window over whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with `name` from 0 in ascending order of the columns; rows equal in all of them in any order.

    Two passes: the rows are dealt by range and sorted, partitions are counted, and each row's number is
    its place in its partition after the rows of the partitions before. Only the counts, one per
    partition, meet in one task.
    """
    dealt = settled(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = counts.select("__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__before"))
    number = (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return dealt.withColumn("__part", part).join(F.broadcast(before), "__part").select(*df.columns, number)


def numbered_within(df: DataFrame, group: str, order: list[str], name: str = "number") -> DataFrame:
    """df with `name` from 0 in each group: its number over all rows less the group's first."""
    rows = settled(numbered(df, [group, *order], "__number"))
    first = rows.groupBy(group).agg(F.min("__number").alias("__first"))
    return rows.join(first, group).select(*df.columns, (F.col("__number") - F.col("__first")).alias(name))
