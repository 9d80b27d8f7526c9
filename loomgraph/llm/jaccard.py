"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, pack, word_codes
from .common import UPPER, WORD_RE, discard, sliced, stored, table
from .tiles import BITS, BROADCAST_ROWS, linked_classes

#: Logarithmic step of the size bands.
STEP = 0.5
#: Parts of a set over those that two linked sets can differ in; the more, the more large tiles a set can leave.
SPARE = 1.3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that are cut into shingles at a time, and keys that one task sorts.
BLOCK = 1 << 23
TASK_KEYS = 2_500_000


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per text its sorted distinct 64-bit shingle codes; fewer words than width make one shingle."""
    codes, bounds = word_codes(column)

    def rolled(at: np.ndarray | None, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = len(codes) - size + 1 if at is None else len(at)
            acc = np.full(max(0, n), np.uint64(size))
            for k in range(size):
                acc = mix((acc ^ (codes[k : k + n] if at is None else codes[at + k])) * MULTIPLIER + np.uint64(k))
        return acc

    size = np.diff(bounds)
    whole = rolled(None, width)
    out = [np.empty(0, np.uint64)] * len(size)
    for m in range(1, width):
        few = np.flatnonzero(size == m)
        for i, x in zip(few.tolist(), rolled(bounds[few], m)):
            out[i] = np.array([x])
    for i in np.flatnonzero(size >= width).tolist():
        s = np.sort(whole[bounds[i] : bounds[i + 1] - width + 1])
        out[i] = s[np.flatnonzero(np.r_[True, s[1:] != s[:-1]])]
    return out


def shingle_words(text: str | None) -> list[str]:
    """The words of a text as shingles take them."""
    return WORD_RE.findall((text or "").translate(UPPER))


def class_id(s: np.ndarray) -> int:
    """A signed 64-bit name of the set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def signatures(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, its owner) and the owners as rows (index of the set, band, spare).

    Per size band a set takes part in, it has one key per part of its elements. A band covers the
    sizes from exp(l * STEP) to exp((l + 1) * STEP) / t; two linked sets share the band of the
    smaller one. Linked sets of sizes n and m differ in at most (1 - t) / (1 + t) * (n + m) elements,
    each of which changes one part, so that a set agrees with any linked one in at least its used
    parts less that limit. If there are none to spare, it has keys for its empty parts too.
    """
    n = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    differ = (1 - threshold) / (1 + threshold)
    with np.errstate(divide="ignore"):
        highest = np.where(n > 0, np.floor(np.log(n) / STEP), 0).astype(np.int64)
    keys, owners, entries = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty((3, 0), np.int64)]
    for back in range(math.ceil(-math.log(threshold) / STEP) + 2):
        level = highest + 1 - back
        low, top = np.exp(level * STEP), np.exp((level + 1) * STEP) / threshold
        member = (n > 0) & (low <= n * (1 + 1e-9)) & (n <= top * (1 + 1e-9))
        if not member.any():
            continue
        parts = np.where(member, np.floor(differ * 2 * top * SPARE + 1e-6).astype(np.int64) + 3, 0)
        base = np.cumsum(parts) - parts
        on = member[owner]
        at, x = owner[on], every[on]
        with np.errstate(over="ignore"):
            salt = mix((level + 1000).astype(np.uint64) * MULTIPLIER)
            slot = base[at] + (mix(x ^ salt[at]) % parts[at].astype(np.uint64)).astype(np.int64)
            total = int(parts.sum())
            value = mix(x)
            # Sums of halves stay exact in doubles up to two million elements of one part.
            sums = np.bincount(slot, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
            sums += np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), total).astype(np.uint64) << np.uint64(32)
            used = np.bincount(slot, minlength=total) > 0
            who = np.repeat(np.arange(len(sets)), parts)
            part = (np.arange(total) - base[who]).astype(np.uint64)
            key = mix(sums ^ mix(part * MULTIPLIER ^ salt[who]))
        limit = np.floor(differ * (n + np.minimum(top, n / threshold)) + 1e-6).astype(np.int64)
        spare = np.bincount(who, used, len(sets)).astype(np.int64) - limit
        kept = used | (spare <= 0)[who]
        keys.append(key[kept])
        owners.append(who[kept] + sum(e.shape[1] for e in entries))
        entries.append(np.stack([np.arange(len(sets)), np.maximum(level, 0), np.maximum(spare, 0)]))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(entries, axis=1)


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(s % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits)


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """100 * intersection >= percent * union of (bitmap, sorted set) pairs, tested on bit counts first.

    Every bit set on one side only stands for at least one element of that side only.
    """
    (x, s), (y, t) = a, b
    n, m = len(s), len(t)
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    if 100 * most < percent * (n + m - most):
        return False
    both = np.concatenate((s, t))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (n + m - common)


def _measured(docs: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, n, cid, bits) of every row of docs(row, doc_id, text)."""

    def part(batches):
        for batch in batches:
            for some in sliced(batch, BLOCK):
                found = shingle_sets(some.column("text"), width)
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([class_id(s) for s in found], pa.int64()), pa.array([bitmap(s).tobytes() for s in found], pa.binary())], names=["row", "doc_id", "n", "cid", "bits"])

    return docs.mapInArrow(part, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, cid long, bits binary")


def _keys(docs: DataFrame, width: int, threshold: float, tasks: int) -> DataFrame:
    """The keys of docs(text) in packed blocks, dealt by key; copies in one block give one set of keys."""

    def part(batches):
        for batch in batches:
            for some in sliced(batch, BLOCK):
                found = shingle_sets(some.column("text"), width)
                names = np.array([class_id(s) for s in found], np.int64)
                _, one = np.unique(names, return_index=True)
                one = one[[len(found[i]) > 0 for i in one]] if len(one) else one
                key, who, (whose, band, spare) = signatures([found[i] for i in one], threshold)
                size = np.array([len(found[i]) for i in one], np.int64)[whose]
                names = names[one][whose]
                task = ((key >> np.uint64(33)) % np.uint64(tasks)).astype(np.int32)
                order = np.lexsort((key, task))
                cuts = np.searchsorted(task[order], np.arange(tasks + 1))
                out = []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    at = order[cuts[k] : cuts[k + 1]]
                    used, own = np.unique(who[at], return_inverse=True)
                    out.append((k, pack(key[at], own.astype(np.uint32), names[used], size[used].astype(np.uint32), band[used].astype(np.uint8), spare[used].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["task", "block"])

    return docs.select("text").mapInArrow(part, "task int, block binary")


def labelled(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) of every row of docs(doc_id, text); see near_duplicates.

    `row` numbers the rows as monotonically_increasing_id does. The table is stored.
    """
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = stored(_measured(docs.select("row", "doc_id", "text"), width), "sets")
    full = rows.where("n > 0")
    total = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, -(-total * 2 // 5 // TASK_KEYS))
    classes = full.groupBy("cid").agg(F.min("row").alias("row"), F.min("doc_id").alias("rep"), F.any_value("bits").alias("bits"))

    def opened(column):
        return [(bitmap(s), s) for s in shingle_sets(column, width)]

    items = docs.select("row", F.col("text").alias("item"))
    blocks = _keys(docs, width, percent / 100, tasks)
    state = linked_classes(blocks, tasks, classes, items, opened, lambda a, b: linked(a, b, percent), percent)
    named = state.join(classes, F.col("node") == F.col("cid")).groupBy("comp").agg(F.min("rep").alias("least"))
    named = state.join(named, "comp").select(F.col("node").alias("cid"), "least")
    own = classes.select("cid", "rep").join(named, "cid", "left").select("cid", F.coalesce("least", "rep").alias("component_id"))
    out = full.join(own, "cid", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = stored(out.union(rows.where("n = 0").select("row", "doc_id", "n", "doc_id")), "labelled")
    discard(rows)
    return out


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text).

    Null, empty and wordless texts have no shingles and are their own component; rows without a
    doc_id name no component, so one whose set nobody else has gets null. Equal sets are one class
    from the start, however many copies there are, repeated rows and ids included. Texts are read
    whole; an empty table gives an empty result; other columns are not read. Words and shingles are
    told apart by 64-bit codes.

    A tile holds the classes that agree in one part of their elements. Its first member is compared
    with all others, then the second, then all pairs that are still in different components and
    whose bit counts allow a link, before the exact intersection. `docs` must give the same rows in the same
    partitions each time it is read, as files do.
    """
    return labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs(doc_id, text, ...) less those whose component has a row of smaller doc_id (ties:
    read earlier). Rows without words or without a doc_id stay; columns stay as they are."""
    found = labelled(docs, width, percent).where("n_shingles > 0 and doc_id is not null")
    kept = found.groupBy("component_id").agg(F.min_by("row", F.struct("doc_id", "row")).alias("kept"))
    dropped = stored(found.join(kept, "component_id").where("row <> kept").select(F.col("row").alias("__row")), "dropped")
    marked = docs.withColumn("__row", F.monotonically_increasing_id())
    small = dropped.count() <= BROADCAST_ROWS
    return marked.join(F.broadcast(dropped) if small else dropped, "__row", "left_anti").drop("__row")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)
