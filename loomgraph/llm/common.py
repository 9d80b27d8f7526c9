"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """The words of a text; a null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(WORD), F.lit(0))


def lower_ascii(text: Column | str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the cluster's shared folder.

    Only a session without spark.checkpoint.dir (a local test) gets a folder of its own.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


#: Bytes of a batch's rows that are turned into Python objects or arrays at a time.
SLICE_BYTES = 1 << 23


def sliced(batch, limit: int = SLICE_BYTES):
    """The Arrow batch in consecutive slices of about `limit` bytes; a larger row is in one of its own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.full(batch.num_rows, 16, np.int64)
    for col in batch.columns:
        if pa.types.is_list(col.type):
            size += 8 * pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
            size += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    group = (size.cumsum() - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def map_columns(df: DataFrame, names: list[str], fn, schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """fn(lists of the named columns) -> lists of the schema's columns, slice by slice over Arrow.

    Python lists keep null ids and full 64-bit integers, which pandas columns would not.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def part(batches):
        import pyarrow as pa

        for batch in batches:
            for some in sliced(batch, limit):
                out = fn(*(some.column(some.schema.get_field_index(n)).to_pylist() for n in names))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target)], schema=target)

    return df.select(*names).mapInArrow(part, schema)


def release() -> None:
    """Gives the system back what ended steps of this process leave in Arrow's pool and in the C library.

    Spark hands a Python worker on from one stage to the next, with all that its allocators keep.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the cluster's shared one; only a local session gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix=f"{name}-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a compressed table to the shared folder and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote and nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
