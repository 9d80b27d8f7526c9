"""Many graphs side by side: a graph's number is part of its nodes' keys, so one job serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

#: Ids are signed 32-bit integers; a graph's keys lie in a stretch of this many, in the order of its ids.
SPAN = 1 << 32


def key(graph: Column, id: Column) -> Column:
    return graph.cast("long") * F.lit(SPAN) + id.cast("long")


def graph_of(key: Column) -> Column:
    return F.shiftright(key + F.lit(SPAN // 2), 32).cast("int")


def own_id(key: Column) -> Column:
    return (key - graph_of(key).cast("long") * F.lit(SPAN)).cast("int")


def united(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, label) and arcs(src, dst, seq) by key, of nodes(graph, id, label) and edges(graph, src, dst, seq)."""
    keyed = edges.select(key(F.col("graph"), F.col("src")).alias("src"), key(F.col("graph"), F.col("dst")).alias("dst"), "seq")
    return nodes.select(key(F.col("graph"), F.col("id")).alias("id"), "label"), P.ordered_arcs(keyed)


def patterns_by_graph(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """(graph, pattern_id, center_label, frequency, center_degree, canonical): every graph's own patterns."""
    found = P.extract_patterns(*united(nodes, edges), radius, by=graph_of)
    return found.withColumn("pattern_id", own_id(F.col("pattern_id")))


def classes_by_graph(nodes: DataFrame, edges: DataFrame, max_radius: int) -> DataFrame:
    """(graph, radius, path, patterns_out, patterns_in): how many of a graph's patterns go out by a path and
    come in by it. Two of them are compatible where one goes out by a path that the other comes in by."""
    _, _, paths = P.learnt_paths(*united(nodes, edges), max_radius, by=graph_of)
    own = paths.select(graph_of(F.col("id")).alias("graph"), "radius", "path")
    out = own.groupBy("graph", "radius", "path").agg(F.count("*").alias("out"))
    into = own.groupBy("graph", "radius", F.reverse("path").alias("path")).agg(F.count("*").alias("into"))
    both = out.join(into, ["graph", "radius", "path"], "full")
    return both.select("graph", "radius", "path", F.coalesce("out", F.lit(0)).alias("patterns_out"), F.coalesce("into", F.lit(0)).alias("patterns_in"))
