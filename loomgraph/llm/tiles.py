"""Tiles of classes that share a key: leaders first, then what is still open, into linked components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mix, pack, unpack
from .common import cut, discard, sliced, stored

#: Bits of a member's bitmap.
BITS = 2048
#: Tiles of fewer classes are not left.
LARGE = 8
#: Bytes of members that are compared at a time.
BLOCK = 1 << 23
#: Rows up to which what is to be fetched is broadcast (24 bytes each); beyond, its items are shuffled.
BROADCAST_ROWS = 2_000_000
#: Members of a tile's leader that are compared in one group.
GROUP = 1_000


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the ends of edges(a, b): least label among neighbours, then pointer jumps."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        new = state.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        roots = state.select(F.col("node").alias("root"), F.col("comp").alias("rootcomp"))
        new = new.join(roots, F.col("next") == F.col("root")).select("node", F.least("next", "rootcomp").alias("comp"), "old")
        new = cut(new)
        state = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return state


def _block(key, cid, n, band, spare, times=None) -> bytes:
    """The tiles of two classes or more, given by key and class: sizes, bands and how many keys have
    just these members; then the members, those that take part in most tiles first (a text that
    others were made from comes before them)."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(key)])
    with np.errstate(over="ignore"):
        mark = np.add.reduceat(mix(cid.view(np.uint64)), first) if len(first) else np.empty(0, np.uint64)
        mark = mix(mark ^ band[first]) if len(first) else mark
    _, kinds, same = np.unique(mark, return_index=True, return_inverse=True)
    times = np.bincount(same, times[first] if times is not None else None, len(kinds))
    keep = np.zeros(len(first), bool)
    keep[kinds] = True
    keep &= size > 1
    all_times = np.zeros(len(first), np.int64)
    all_times[kinds] = times
    on = np.repeat(keep, size)
    tile = np.repeat(np.arange(len(first)), size)[on]
    cid, n, spare = cid[on], n[on], spare[on]
    names, own = np.unique(cid, return_inverse=True)
    degree = np.bincount(own, all_times[tile], len(names))[own]
    order = np.lexsort((cid, -degree, tile))
    return pack(size[keep].astype(np.uint32), band[first][keep].astype(np.uint8), all_times[keep].astype(np.uint32), cid[order], n[order].astype(np.uint32), spare[order].astype(np.uint32))


def _tiles(blocks: DataFrame) -> DataFrame:
    """(task, block): one row per task with its tiles."""

    def part(batches):
        found, task = [], None
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, own, *rest = unpack(block)
                found.append((key, *(x[own] for x in rest)))
                task = k
        if not found:
            return
        key = np.concatenate([x[0] for x in found])
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        key, order = key[shared], order[shared]
        cid, n, band, spare = (np.concatenate([x[k] for x in found])[order] for k in (1, 2, 3, 4))
        del found
        order = np.lexsort((cid, key))
        order = order[np.r_[True, (np.diff(key[order]) != 0) | (np.diff(cid[order]) != 0)]] if len(key) else order
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([_block(*(x[order] for x in (key, cid, n, band, spare)))], pa.binary())], names=["task", "block"])

    return blocks.mapInArrow(part, "task int, block binary")


def _told(tiles: DataFrame, asked, values: DataFrame, tasks: int, fn, schema: str) -> DataFrame:
    """fn(task, block's arrays, rows of cid, band and value, bitmaps of these) of every task's block, with
    the values(cid, band, value, bits) of those members that asked(arrays) -> (cid, band) picks."""

    def members(batches):
        for batch in batches:
            for task, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cid, band = asked(*unpack(block))
                both = np.unique(np.stack([cid, band.astype(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(both.shape[1], task, np.int32)), pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["task", "cid", "band"])

    known = tiles.mapInArrow(members, "task int, cid long, band long").join(values, ["cid", "band"]).select("task", F.lit(None).cast("binary").alias("block"), "cid", "band", "value", "bits")
    blank = F.lit(None).cast("long")
    both = tiles.select("task", "block", blank.alias("cid"), blank.alias("band"), blank.alias("value"), F.lit(None).cast("binary").alias("bits")).unionByName(known)

    def part(batches):
        blocks, rows, bits = [], [np.empty((3, 0), np.int64)], []
        for batch in batches:
            blocks += zip(batch.column("task").to_pylist(), batch.column("block").to_pylist())
            rows.append(np.stack([batch.column(k).drop_null().to_numpy() for k in ("cid", "band", "value")]))
            bits += batch.column("bits").drop_null().to_pylist()
        rows = np.concatenate(rows, axis=1)
        order = np.lexsort((rows[1], rows[0]))
        rows = rows[:, order]
        bits = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64)
        bits = bits[order] if len(bits) else bits
        for task, block in blocks:
            if block is not None:
                yield from fn(task, unpack(block), rows, bits)

    return both.repartitionById(tasks, F.col("task")).mapInArrow(part, schema)


def _value(rows: np.ndarray, cid: np.ndarray, band: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The value of each (cid, band) among the sorted rows, `other` where there is none."""
    if not rows.shape[1]:
        return other
    names = np.unique(rows[0])
    key = np.searchsorted(names, rows[0]) * 512 + rows[1]
    at = np.minimum(np.searchsorted(names, cid), len(names) - 1)
    want = at * 512 + band.astype(np.int64)
    place = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return np.where((names[at] == cid) & (key[place] == want), rows[2][place], other)


def _pruned(tiles: DataFrame, tasks: int) -> DataFrame:
    """The tiles without the members that need not be there.

    A set agrees with any linked one in at least `spare` keys of a band. If it leaves fewer than
    that, the largest tiles first, and so do all others, one common key is left to each linked pair,
    as what the two leave of their common keys are the largest tiles of these.
    """

    def count(batches):
        for batch in batches:
            for block in batch.column(1).to_pylist():
                size, band, times, cid, _, spare = unpack(block)
                large = np.repeat(size >= LARGE, size)
                rows = np.stack([cid[large], np.repeat(band, size)[large].astype(np.int64), spare[large].astype(np.int64), np.repeat(np.floor(np.log2(np.maximum(size, 1))).astype(np.int64), size)[large]])
                kinds, at = np.unique(rows, axis=1, return_inverse=True)
                n = np.bincount(at.ravel(), np.repeat(times, size)[large], kinds.shape[1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in kinds), pa.array(n, pa.int64())], names=["cid", "band", "spare", "log", "n"])

    logs = tiles.mapInArrow(count, "cid long, band long, spare long, log long, n long").groupBy("cid", "band", "spare", "log").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("cid", "band").orderBy(F.desc("log"))
    leave = logs.withColumn("so_far", F.sum("n").over(down)).where("so_far < spare").groupBy("cid", "band").agg(F.min("log").alias("value")).withColumn("bits", F.lit(None).cast("binary"))

    def asked(size, band, times, cid, n, spare):
        large = np.repeat(size >= LARGE, size)
        return cid[large], np.repeat(band, size)[large]

    def keep(task, arrays, rows, bits):
        size, band, times, cid, n, spare = arrays
        bands, sizes = np.repeat(band, size), np.repeat(size, size)
        log = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        stay = (sizes < LARGE) | (log < _value(rows, cid, bands, np.full(len(cid), 64)))
        tile = np.repeat(np.arange(len(size)), size)
        order = np.flatnonzero(stay)
        order = order[np.lexsort((cid[order], tile[order]))]
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([_block(*(x[order] for x in (tile, cid, n, bands, spare, np.repeat(times, size))))], pa.binary())], names=["task", "block"])

    return _told(tiles, asked, leave, tasks, keep, "task int, block binary")


def _distinct(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    names, own = np.unique(np.r_[a, b], return_inverse=True)
    key = np.unique(own[: len(a)] * len(names) + own[len(a) :])
    return pa.RecordBatch.from_arrays([pa.array(names[key // max(1, len(names))], pa.int64()), pa.array(names[key % max(1, len(names))], pa.int64())], names=["a", "b"])


def _led(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b): of every tile its first member with the others that it may link by size."""

    def part(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                size, _, _, cid, n, _ = unpack(block)
                first = np.cumsum(size, dtype=np.int64) - size
                a, m = np.repeat(cid[first], size), np.repeat(n[first], size).astype(np.int64)
                ok = (a != cid) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
                yield _distinct(a[ok], cid[ok])

    return tiles.select("block").mapInArrow(part, "a long, b long").distinct()


def _open(tiles: DataFrame, state: DataFrame, tasks: int, after: int) -> DataFrame:
    """The tiles whose members after the first `after` are in different components by state(node, comp);
    the component takes the place of `spare`."""

    def asked(size, band, times, cid, n, spare):
        some = cid[np.repeat(size > after + 1, size)]
        return some, np.zeros(len(some))

    def keep(task, arrays, rows, bits):
        size, band, times, cid, n, _ = arrays
        comp = _value(rows, cid, np.zeros(len(cid)), cid)
        first = np.cumsum(size, dtype=np.int64) - size
        different = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first) if len(first) else np.empty(0, bool)
        some = different & (size > after + 1)
        on = np.repeat(some, size)
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([pack(size[some], band[some], times[some], cid[on], n[on], comp[on])], pa.binary())], names=["task", "block"])

    values = state.select(F.col("node").alias("cid"), F.lit(0).cast("long").alias("band"), F.col("comp").alias("value"), F.lit(None).cast("binary").alias("bits"))
    return _told(tiles, asked, values, tasks, keep, "task int, block binary")


def _second(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b): of every open tile its second member with the later ones in other components."""

    def part(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                size, _, _, cid, n, comp = unpack(block)
                at = np.cumsum(size, dtype=np.int64) - size + 1
                a, m, g = np.repeat(cid[at], size), np.repeat(n[at], size).astype(np.int64), np.repeat(comp[at], size)
                ok = (np.arange(len(cid)) > np.repeat(at, size)) & (g != comp) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
                yield _distinct(a[ok], cid[ok])

    return tiles.select("block").mapInArrow(part, "a long, b long").distinct()


def _rest(tiles: DataFrame, classes: DataFrame, tasks: int, percent: int) -> DataFrame:
    """(a, b): of every open tile all pairs after the second member that are in different components
    and whose sizes and bit counts allow the link."""

    def asked(size, band, times, cid, n, comp):
        return cid, np.zeros(len(cid))

    def pairs(task, arrays, rows, bits):
        size, _, _, cid, n, comp = arrays
        place = np.searchsorted(rows[0], cid)
        for f, k in zip((np.cumsum(size, dtype=np.int64) - size).tolist(), size.tolist()):
            f, k = f + 2, k - 2
            c, g, s, x = cid[f : f + k], comp[f : f + k], n[f : f + k].astype(np.int64), bits[place[f : f + k]]
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(k - 1):
                j = i + 1 + np.flatnonzero((g[i + 1 :] != g[i]) & (100 * np.minimum(s[i], s[i + 1 :]) >= percent * np.maximum(s[i], s[i + 1 :])))
                most = np.minimum(s[i] - np.bitwise_count(x[i] & ~x[j]).sum(1, dtype=np.int64), s[j] - np.bitwise_count(x[j] & ~x[i]).sum(1, dtype=np.int64))
                j = j[100 * most >= percent * (s[i] + s[j] - most)]
                a.append(np.minimum(c[i], c[j]))
                b.append(np.maximum(c[i], c[j]))
            yield _distinct(np.concatenate(a), np.concatenate(b))

    values = classes.select("cid", F.lit(0).cast("long").alias("band"), F.lit(0).cast("long").alias("value"), "bits")
    return _told(tiles, asked, values, tasks, pairs, "a long, b long").distinct()


def _verified(pairs: DataFrame, items: DataFrame, wanted: DataFrame, open_items, same) -> DataFrame:
    """The pairs(a, b) of classes that are linked: same(leader's item, member's), opened by
    open_items(column) from items(row, item) of wanted(cid, row).

    A leader's members are dealt into groups, each of which meets the leader's item.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(groups, "a").select("a", F.pmod(F.hash("b"), F.col("groups")).alias("g"), F.col("b").alias("x"))
    fetch = dealt.union(dealt.select("a", "g", F.col("a").alias("x")).distinct())
    fetch = stored(fetch.join(wanted.withColumnRenamed("cid", "x"), "x").select("row", "a", "g", "x"), "fetch")
    rows = fetch.join(items, "row") if fetch.count() > BROADCAST_ROWS else items.join(F.broadcast(fetch), "row")
    rows = rows.select("a", "g", "x", "item").repartition("a", "g").sortWithinPartitions("a", "g", F.col("x") != F.col("a"))

    def part(batches):
        leader, mine = None, None
        for batch in batches:
            for some in sliced(batch, BLOCK):
                a, g, x = (some.column(k).to_numpy() for k in ("a", "g", "x"))
                found = open_items(some.column("item"))
                ok = []
                for i in range(len(a)):
                    if a[i] == x[i]:
                        leader, mine = (a[i], g[i]), found[i]
                    elif leader != (a[i], g[i]):
                        raise ValueError("the rows changed between two reads")
                    elif same(mine, found[i]):
                        ok.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(x[ok])], names=["a", "b"])

    return rows.mapInArrow(part, "a long, b long")


def linked_classes(blocks: DataFrame, tasks: int, classes: DataFrame, items: DataFrame, open_items, same, percent: int) -> DataFrame:
    """(node, comp) of all classes that are linked with another.

    blocks(task, block) hold packed (key, owner, then per owner class, size, band, spare); equal keys
    are in the same one of `tasks` tasks. classes(cid, row, bits) name a row of items(row, item) each.
    Classes link only if 100 * smaller size >= percent * larger, and if the bit counts of their
    bitmaps allow that share of elements (percent 0: always).
    """
    every = stored(_tiles(blocks.repartitionById(tasks, F.col("task"))), "tiles")
    tiles = stored(_pruned(every, tasks), "pruned")
    discard(every)
    links, state = None, blocks.sparkSession.createDataFrame([], "node long, comp long")
    for turn in range(3):
        if turn:
            # Tiles of two, and what the first members' links have joined, need no more.
            tiles, before = stored(_open(tiles, state, tasks, turn), "open"), tiles
            discard(before)
        found = _rest(tiles, classes, tasks, percent) if turn == 2 else (_led, _second)[turn](tiles, percent)
        pairs = stored(found, "pairs")
        if not pairs.isEmpty():
            new = stored(_verified(pairs, items, classes.select("cid", "row"), open_items, same), "links")
            if not new.isEmpty():
                links = new if links is None else links.union(new)
                state = components(links)
        discard(pairs)
    discard(tiles)
    return state
