"""Folders of numbered graphs: discovery, loading, resuming and export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered_within
from .text import load_graph, parse_pairs


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def last_index(spark: SparkSession, folder: str, start: int = 1) -> int:
    """The largest number of the folder's graphedges files, `start` if there are none; a name with another ending fails."""
    path, store = _path(spark, folder)
    names = [f.getPath().getName() for f in store.listStatus(path)]
    return max([int(n.removeprefix("graphedges")) for n in names if n.startswith("graphedges")], default=start)


def graph_of(spark: SparkSession, folder: str, index: int) -> tuple[DataFrame, DataFrame]:
    return load_graph(spark, f"{folder}/graphedges{index}", f"{folder}/graphlabels{index}")


def load_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(graph, id, label), edges(graph, src, dst, seq)) of all graphedgesK and graphlabelsK of the folder.

    Each kind is one scan; seq is the line's number in its file. As with load_graph, the last label of an
    id wins and none is 0; a name with another ending fails. A folder without graphs gives empty tables.
    """

    def scan(kind: str, first: str, second: str) -> DataFrame:
        files = spark.read.option("pathGlobFilter", f"{kind}*").text(folder)
        graph = F.substring_index("_metadata.file_name", kind, -1).cast("int")
        # Blocks of a file may be read in any order; inside one, lines go by their place.
        lines = files.select("value", graph.alias("graph"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        return parse_pairs(numbered_within(lines, "graph", ["block", "at"], "seq").drop("block", "at"), first, second)

    edges = scan("graphedges", "src", "dst")
    named = scan("graphlabels", "id", "label")
    last = named.groupBy("graph", "id").agg(F.max_by("label", "seq").alias("label"))
    ids = edges.select("graph", F.col("src").alias("id")).union(edges.select("graph", "dst")).union(named.select("graph", "id")).distinct()
    nodes = ids.join(last, ["graph", "id"], "left").select("graph", "id", F.coalesce("label", F.lit(0)).alias("label"))
    return nodes, edges.select("graph", "src", "dst", "seq")


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(graph) of the graphs that write_graphs has published in the folder."""
    path, store = _path(spark, folder)
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return spark.createDataFrame([(int(n.removeprefix("graph=")),) for n in names if n.startswith("graph=")], "graph int")


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Moves a graph's staged folder into place in one step, unless another attempt has been there before."""
    path, store = _path(spark, staged)
    aim = _path(spark, target)[0]
    return False if store.exists(aim) else bool(store.rename(path, aim))


def write_graphs(nodes: DataFrame, edges: DataFrame, folder: str) -> int:
    """Writes nodes(graph, id, label) and edges(graph, src, dst) as folder/graph=K/kind=labels and kind=edges.

    Lines are `id label`, and `u v` with u < v once per edge, both in order of their numbers over the parts of
    a kind. All graphs that are not in the folder yet are written by one job beside it and moved in one by
    one, each as a whole: an attempt that breaks off leaves whole graphs only, and the next one
    writes the others. Gives the number of graphs published. Nodes and edges must not be null.
    """
    spark = nodes.sparkSession
    done = finished(spark, folder)
    labels = nodes.join(done, "graph", "left_anti").select("graph", F.lit("labels").alias("kind"), F.col("id").alias("u"), F.col("label").alias("v"))
    pairs = edges.join(done, "graph", "left_anti").where("src < dst").select("graph", F.lit("edges").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    order = ["graph", "kind", "u", "v"]
    lines = labels.union(pairs).repartitionByRange(*order).sortWithinPartitions(*order)
    staging = f"{folder}/.staging-{uuid.uuid4().hex}"
    lines.select("graph", "kind", F.concat_ws(" ", "u", "v").alias("value")).write.partitionBy("graph", "kind").text(staging)
    path, store = _path(spark, staging)
    names = [f.getPath().getName() for f in store.listStatus(path)]
    moved = sum(publish(spark, f"{staging}/{n}", f"{folder}/{n}") for n in sorted(names) if n.startswith("graph="))
    store.delete(path, True)
    return moved


def resume_index(spark: SparkSession, file: str) -> int:
    """The first line of the resume file, 1 if it is missing or no number."""
    path, store = _path(spark, file)
    if not store.exists(path):
        return 1
    lines = spark.read.text(file).limit(1).collect()
    text = lines[0]["value"].strip() if lines else ""
    return int(text) if text.lstrip("+-").isdigit() else 1


def save_index(spark: SparkSession, file: str, index: int) -> None:
    """Writes the next index; a failure to do so only loses the resume state."""
    path, store = _path(spark, file)
    try:
        out = store.create(path, True)
        out.write(bytearray(f"{index}\n".encode()))
        out.close()
    except Exception:  # noqa: BLE001
        pass


def forget_index(spark: SparkSession, file: str) -> None:
    path, store = _path(spark, file)
    store.delete(path, False)


def write_lines(spark: SparkSession, file: str, lines: list[str]) -> None:
    path, store = _path(spark, file)
    out = store.create(path, True)
    out.write(bytearray("".join(f"{line}\n" for line in lines).encode()))
    out.close()
