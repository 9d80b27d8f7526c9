"""Edge and label lists as text: one `u v` or `id label` per line, `#` and `//` comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def strip_comments(line):
    """The line up to the first comment mark, without control characters and blanks at its ends."""
    return F.regexp_replace(F.regexp_replace(line, r"(#|//).*$", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def read_pairs(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """Lines with fewer than two tokens are skipped, further tokens ignored; a non-integer fails."""
    rows = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return parse_pairs(rows, first, second)


def parse_pairs(lines: DataFrame, first: str, second: str) -> DataFrame:
    """read_pairs over lines(value, seq); further columns are kept."""
    kept = [c for c in lines.columns if c != "value"]
    rows = lines.select(F.split(strip_comments(F.col("value")), r"\s+").alias("t"), *kept).where("size(t) >= 2")
    return rows.select(F.col("t")[0].cast("int").alias(first), F.col("t")[1].cast("int").alias(second), *kept)


def load_graph(spark: SparkSession, edges: str | None = None, labels: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, label), edges(src, dst, seq)); the last label of an id wins, none is 0."""
    e = read_pairs(spark, edges, "src", "dst") if edges else spark.createDataFrame([], "src int, dst int, seq long")
    named = read_pairs(spark, labels, "id", "label") if labels else spark.createDataFrame([], "id int, label int, seq long")
    last = last_labels(named)
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).union(named.select("id")).distinct()
    return ids.join(last, "id", "left").select("id", F.coalesce("label", F.lit(0)).alias("label")), e


def last_labels(named: DataFrame) -> DataFrame:
    """(id, label) of named(id, label, seq): the last row of an id wins."""
    return named.groupBy("id").agg(F.max_by("label", "seq").alias("label"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """`u v` once per undirected edge with u < v, and `id label`; the parts in their order are sorted by number."""
    edges.where("src < dst").select("src", "dst").distinct().orderBy("src", "dst").select(F.concat_ws(" ", "src", "dst")).write.mode("overwrite").text(f"{path}/edges")
    nodes.orderBy("id").select(F.concat_ws(" ", "id", "label")).write.mode("overwrite").text(f"{path}/labels")
