"""Greedy wiring as rounds of pairs that are first at both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled


def greedy(pairs: DataFrame, open_ends: DataFrame) -> DataFrame:
    """(run, u, v) that a pass by (score descending, u, v) over pairs(run, u, v, score) would take while both
    ends have stubs left in open_ends(cell, stubs).

    A pair that is first among the remaining pairs of both its ends is taken whatever else happens, so
    each round takes all of those at once; the order is total, so the result is that of the pass.
    """
    left = settled(pairs.select("run", "u", "v", "score"))
    stubs = settled(open_ends.select("cell", "stubs"))
    taken = None
    while True:
        ends = left.select("u", "v", "score", F.col("u").alias("cell")).union(left.select("u", "v", "score", F.col("v").alias("cell")))
        ranked = ends.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("score"), "u", "v")))
        first = ranked.where("place = 1").groupBy("u", "v").count().where("count = 2").select("u", "v")
        now = settled(left.join(first, ["u", "v"], "left_semi").select("run", "u", "v"))
        if now.isEmpty():
            return taken if taken is not None else now
        taken = now if taken is None else taken.union(now)
        used = now.select(F.col("u").alias("cell")).union(now.select("v")).groupBy("cell").agg(F.count("*").alias("used"))
        stubs = settled(stubs.join(used, "cell", "left").select("cell", (F.col("stubs") - F.coalesce("used", F.lit(0))).alias("stubs")).where("stubs > 0"))
        left = left.join(now.select("u", "v"), ["u", "v"], "left_anti")
        left = left.join(stubs.select(F.col("cell").alias("u")), "u", "left_semi").join(stubs.select(F.col("cell").alias("v")), "v", "left_semi")
        left = settled(left.select("run", "u", "v", "score"))
