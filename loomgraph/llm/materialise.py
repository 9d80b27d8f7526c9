"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import buffer, pack, unpack
from .common import shared_folder, sliced, table

ROUNDS = 6
#: Token ids (UTF-8 bytes) of a sequence, and sequences of a shard.
STRIDE = 1024
SHARD_ROWS = 16_384
#: Bytes of texts that are cut into sequences at a time.
BLOCK = 1 << 24


def record_type(stride: int) -> np.dtype:
    """A record of a shard; the text writer ends each with a line break."""
    return np.dtype([("ids", "u1", stride), ("used", ">u4"), ("chunk", ">u4"), ("known", "u1"), ("doc_id", ">i8"), ("end", "u1")])


RECORD = record_type(STRIDE).itemsize


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A bijection of 0..n-1: Feistel rounds on the next even number of bits, walked back under n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for r in range(ROUNDS):
            with np.errstate(over="ignore"):
                f = (right + np.uint64(key * 31 + r + 1)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def write_shards(docs: DataFrame, path: str, key: int = 1, stride: int = STRIDE, shard_rows: int = SHARD_ROWS) -> int:
    """Cuts the texts of docs(doc_id long, text) into sequences of `stride` byte ids, gives each a slot,
    writes them by slot and returns how many there are.

    The folder path/shard=k holds one file of the slots from k * shard_rows on, as records of fixed
    size: slot s starts at byte (s % shard_rows) * record size. A record holds the ids (zeros after
    the last), how many are used, the sequence's number in its text, whether the row has a doc_id,
    and the doc_id. Null and empty texts have no sequence; repeated rows each have theirs; an empty
    table writes nothing; other columns are not read.

    A sequence's place is its number in the order of docs' partitions, so that only one count per
    partition meets the driver; the slot is the permuted place. Partitions of files are the same at
    each read. Each task gathers and writes whole shards, so the ids are shuffled once, compressed.
    """
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    runs = F.ceil(F.octet_length("text") / stride)
    per_part = docs.groupBy(F.shiftright("row", 33).alias("p")).agg(F.coalesce(F.sum(runs), F.lit(0)).alias("n")).orderBy("p").collect()
    starts, total = {}, 0
    for r in per_part:
        starts[r["p"]], total = total, total + r["n"]
    if not total:
        return 0
    shards = -(-total // shard_rows)

    def deal(batches):
        at = None
        for batch in batches:
            for some in sliced(batch, BLOCK):
                if at is None:
                    at = starts[some.column("row")[0].as_py() >> 33]
                raw, bounds = buffer(some.column("text"))
                size = np.diff(bounds)
                runs = -(-size // stride)
                doc = np.repeat(np.arange(len(size)), runs)
                chunk = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
                begin = bounds[doc] + chunk * stride
                used = np.minimum(stride, bounds[doc + 1] - begin)
                slot = permute(at + np.arange(len(doc)), total, key)
                at += len(doc)
                known = some.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ids = some.column("doc_id").fill_null(0).to_numpy()
                order = np.argsort(slot)
                cuts = np.flatnonzero(np.diff(slot[order] // shard_rows, prepend=-1, append=-1)).tolist()
                out = []
                for a, b in zip(cuts, cuts[1:]):
                    o = order[a:b]
                    n = used[o]
                    flat = raw[np.repeat(begin[o] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    out.append((int(slot[o[0]] // shard_rows), pack(slot[o], n.astype(np.uint32), chunk[o].astype(np.uint32), known[doc[o]].astype(np.uint8), ids[doc[o]].astype(np.int64), flat, level=3)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["shard", "block"])

    def gather(batches):
        blocks: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks.setdefault(k, []).append(block)
        for k, some in sorted(blocks.items()):
            rows = np.zeros(min(shard_rows, total - k * shard_rows), record_type(stride))
            rows["end"] = 10
            filled = 0
            for block in some:
                slot, used, chunk, known, ids, flat = unpack(block)
                at = slot - k * shard_rows
                cell = np.arange(stride) < used[:, None]
                body = np.zeros((len(at), stride), np.uint8)
                body[cell] = flat
                rows["ids"][at] = body
                for name, values in (("used", used), ("chunk", chunk), ("known", known), ("doc_id", ids)):
                    rows[name][at] = values
                filled += len(at)
            if filled != len(rows):
                raise ValueError("the texts changed between two reads")
            raw, step = rows.tobytes(), 1024 * rows.itemsize
            parts = [raw[a : a + step][:-1] for a in range(0, len(raw), step)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["shard", "part", "value"])

    dealt = docs.mapInArrow(deal, "shard int, block binary").repartitionById(shards, F.col("shard"))
    records = dealt.mapInArrow(gather, "shard int, part int, value binary").sortWithinPartitions("shard", "part")
    records.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    return total


def read_shards(spark: SparkSession, path: str, first: int = 0, stride: int = STRIDE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(slot, doc_id, chunk, ids) of the slots from `first` on that write_shards wrote; shards before that
    of `first` are not read."""
    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= first // shard_rows)

    def part(batches):
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.frombuffer(content.as_buffer(), record_type(stride))
                for lo in range(max(0, first - k * shard_rows), len(rows), 4096):
                    some = rows[lo : lo + 4096]
                    used = some["used"].astype(np.int64)
                    body = np.ascontiguousarray(some["ids"])[np.arange(stride) < used[:, None]]
                    offsets = pa.py_buffer(np.r_[0, np.cumsum(used)].astype(np.int32))
                    ids = pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(body)])
                    doc_id = pa.array(some["doc_id"].astype(np.int64), mask=some["known"] == 0)
                    yield pa.RecordBatch.from_arrays([pa.array(k * shard_rows + lo + np.arange(len(some))), doc_id, pa.array(some["chunk"].astype(np.int64)), ids], names=["slot", "doc_id", "chunk", "ids"])

    return files.select(F.col("shard").cast("int"), "content").mapInArrow(part, "slot long, doc_id long, chunk long, ids binary")


def op8_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to shards in training order and read back: where each sequence stands, and
    the digest of what stands there."""
    path = shared_folder(spark, "shards")
    if not write_shards(table(spark, sf_dir, "documents"), path):
        return spark.createDataFrame([], "doc_id long, chunk long, n_bytes int, slot long, shard long, offset long, payload_sha256 string")
    out = read_shards(spark, path)
    return out.select("doc_id", "chunk", F.octet_length("ids").alias("n_bytes"), "slot", F.floor(F.col("slot") / SHARD_ROWS).alias("shard"), ((F.col("slot") % SHARD_ROWS) * RECORD).alias("offset"), F.sha2("ids", 256).alias("payload_sha256"))
