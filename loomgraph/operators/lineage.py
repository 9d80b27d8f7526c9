"""Cutting the lineage of iterated plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lineage-"))
    return named or spark.sparkContext.getCheckpointDir()


#: Rows of a shuffled table that one task takes in.
TASK_ROWS = 150_000


def tasks(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """How many parts a table of so many rows is shuffled into: a task's memory does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (each or TASK_ROWS)))


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """df as a table of the checkpoint folder, in no more parts than a shuffle has.

    For loops: the parts of unions do not add up, and unlike a checkpoint's a table's plan holds no
    constraints, which grow from round to round, and its size is known.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/round-{uuid.uuid4().hex}"
    df.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
