"""Runs of repeated words: suffix arrays, longest previous factors, blocks, and extension at their edges."""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, word_codes
from .common import sliced, table, words

#: A run has at least LEAST words and POWERS periods.
LEAST, POWERS = 24, 3
ODD = np.uint64(0x9E3779B97F4A7C15)


class Suffixes:
    """The suffix array of several sequences of 64-bit codes, each closed by a mark of its own.

    ranks[k][i] tells apart the stretches of 2**k words from i; a stretch with a mark is like no other.
    """

    def __init__(self, codes: np.ndarray, is_mark: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        new = np.r_[True, codes[order][1:] != codes[order][:-1]] | is_mark[order]
        new[1:] |= is_mark[order][:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.ranks, self.order = [rank], order
        while True:
            heads = rank[order]
            same = heads[1:] == heads[:-1]
            slots = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
            if not len(slots):
                break
            at = order[slots]
            key = rank[at].astype(np.int64) * n + rank[at + (1 << (len(self.ranks) - 1))]
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[slots] = at
            new = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            self.ranks.append(rank)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, i != j."""
        found = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.ranks) - 1)):
            rank = self.ranks[k]
            found += (rank[i + found] == rank[j + found]).astype(np.int64) << k
        return found

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j, i != j."""
        found = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.ranks) - 1)):
            a, b, rank = i - found - (1 << k), j - found - (1 << k), self.ranks[k]
            inside = (a >= 0) & (b >= 0)
            found += (inside & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << k
        return found

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest factor at each position that also starts earlier; overlaps count."""
        length, source = np.zeros(len(self.order), np.int64), np.full(len(self.order), -1, np.int64)
        heads = self.ranks[0][self.order]
        joined = np.flatnonzero(np.r_[False, heads[1:] == heads[:-1]])
        lcp = np.zeros(len(self.order), np.int64)
        lcp[joined] = self.ahead(self.order[joined - 1], self.order[joined])
        slots = np.union1d(joined, joined - 1)
        stack: list[tuple[int, int]] = []
        for at, common in itertools.chain(zip(self.order[slots].tolist(), lcp[slots].tolist()), [(-1, 0)]):
            while stack and at < stack[-1][0]:
                top, below = stack.pop()
                if below >= common:
                    length[top], source[top] = below, stack[-1][0] if below else -1
                else:
                    length[top], source[top] = common, at
                common = min(common, below)
            stack.append((at, common))
        return length, source


def _suspects(codes: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """The texts in which a stretch of at least `width` words may come twice."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h, step = mix(codes + ODD), 1
    with np.errstate(over="ignore"):
        while 2 * step <= width and len(h) > step:
            h = mix(h[:-step] * ODD + h[step:])
            step *= 2
        at = np.arange(len(h))
        at = at[at + step <= bounds[owner[: len(h)] + 1]]
        keys = h[at] ^ mix(owner[at].astype(np.uint64) + ODD)
    order = np.argsort(keys)
    twice = keys[order][1:] == keys[order][:-1]
    return np.unique(owner[at[order[1:][twice]]])


def _at_edges(s: Suffixes, edges: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray, least: int, powers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs that touch an edge between blocks of `left` and `right` words,
    the least period of each stretch.

    A run that no earlier edge gives has fewer than (left + right) / (powers - 1) words in its period; it
    holds a whole period on one side of the edge, so it is found by extending both ways from there.
    """
    most = np.maximum((left + right - 1) // (powers - 1), 0)
    which = np.repeat(np.arange(len(edges)), most)
    period = np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most) + 1
    need = np.maximum(least, powers * period) - period
    found = []
    for shift in (0, 1):
        i = edges[which] - shift * period
        ok = (i >= first[which]) & (i + period <= last[which])
        i, q, n = i[ok], period[ok], need[ok]
        # One of the two extensions is at least half of what is needed.
        k = max(0, min(int(n.min() + 1) // 2, 1 << (len(s.ranks) - 1)).bit_length() - 1) if len(n) else 0
        rank, back = s.ranks[k], i - (1 << k)
        maybe = (rank[i] == rank[i + q]) | ((back >= 0) & (rank[np.maximum(back, 0)] == rank[np.maximum(back, 0) + q]))
        i, q, n = i[maybe], q[maybe], n[maybe]
        before, after = s.behind(i, i + q), s.ahead(i, i + q)
        long = before + after >= n
        found.append(np.stack([i - before, i + q + after, q])[:, long])
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    one = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    return start[one], end[one], period[one]


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST, powers: int = POWERS) -> dict[int, list[tuple[int, int, int]]]:
    """text number -> its (start, length, period) by start, then period, for the texts that have runs.

    codes are the words of texts, text k having those from bounds[k] to bounds[k + 1].
    """
    width = min(max(least, powers * q) - q for q in range(1, max(least, 1) + 1))
    some = _suspects(codes, bounds, width)
    if not len(some):
        return {}
    size = bounds[some + 1] - bounds[some]
    first = np.cumsum(size + 1) - (size + 1)
    inside = np.ones(int((size + 1).sum()), bool)
    last = first + size
    inside[last] = False
    joined = np.zeros(len(inside), np.uint64)
    joined[inside] = codes[np.repeat(bounds[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] ^ mix(np.repeat(some, size).astype(np.uint64))
    s = Suffixes(joined, ~inside)
    length, source = s.previous()
    steps = np.maximum(length, 1).tolist()
    edges, left, right, text = [], [], [], []
    for k, (at, end) in enumerate(zip(first.tolist(), last.tolist())):
        before = 0
        while at < end:
            edges.append(at), left.append(before), right.append(steps[at]), text.append(k)
            before = steps[at]
            at += before
        edges.append(end), left.append(before), right.append(0), text.append(k)
    edges, left, right, text = map(np.array, (edges, left, right, text))
    start, end, period = _at_edges(s, edges, left, right, first[text], last[text], least, powers)
    out: dict[int, list[tuple[int, int, int]]] = {}
    owner = np.searchsorted(first, start, "right") - 1
    for k, a, b, q in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist()):
        out.setdefault(k, []).append((a, b, q))
    # Runs strictly inside a block are those of its earlier copy: buckets by start, block by block.
    wide = right >= least + 2
    for k, at, n in zip(text[wide].tolist(), edges[wide].tolist(), right[wide].tolist()):
        runs = out.get(k)
        if runs is None:
            continue
        origin = int(source[at])
        shift, limit = at - origin, origin + n - 1
        new = []
        for a, b, q in runs[bisect.bisect_right(runs, (origin, np.inf)) : bisect.bisect_right(runs, (at, np.inf))]:
            while b <= limit:
                a, b = a + shift, b + shift
                new.append((a, b, q))
        if new:
            out[k] = sorted(runs + new)
    return {int(some[k]): sorted(((a - int(first[k]), b - a, q) for a, b, q in runs), key=lambda r: (r[0], r[2])) for k, runs in out.items()}


def find_runs(docs: DataFrame, least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> by start and period, collapsed, of every row.

    A run is a longest stretch of words with a least period q, of at least max(least, powers * q) words.
    `collapsed` holds the words joined by one blank, without those a run contains after its first q.
    Null texts have no words; repeated rows stay as they are, further columns are left out. Words are
    told apart by 64-bit codes, of which two different words share one with probability 2**-64.
    """
    if powers < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    kind = dict(docs.dtypes)["doc_id"]

    def part(batches):
        for batch in batches:
            for some in sliced(batch):
                texts = some.column(1)
                codes, bounds = word_codes(texts, lower=False)
                found = runs_of(codes, bounds, least, powers)
                collapsed = []
                for k, text in enumerate(texts):
                    kept = (text.as_py() or "").encode().split()
                    if k in found:
                        keep = np.ones(len(kept), bool)
                        for start, length, period in found[k]:
                            keep[start + period : start + length] = False
                        kept = itertools.compress(kept, keep.tolist())
                    collapsed.append(b" ".join(kept).decode())
                runs = [[{"start": a, "length": n, "period": q} for a, n, q in found.get(k, ())] for k in range(some.num_rows)]
                item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(bounds)), pa.array(runs, pa.list_(item)), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, where one in ten texts has its words repeated from some place on: with h the CRC-32 of
    doc_id in decimals and g = h div 10, each word i >= a = g mod n becomes word a + (i - a) mod p, for
    p = 1 + (n - a) div (3 + g mod 8). Rows without doc_id or words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words("text")).alias("w"))
    rows = rows.withColumn("n", F.size(F.coalesce("w", F.array().cast("array<string>")))).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def _first(x, y):
    """Greater length / period first, compared as whole numbers, then smaller start and period."""
    one, two = x["length"] * y["period"], y["length"] * x["period"]
    order = F.when(one != two, F.sign((two - one).cast("double"))).when(x["start"] != y["start"], F.sign((x["start"] - y["start"]).cast("double"))).otherwise(F.sign((x["period"] - y["period"]).cast("double")))
    return order.cast("int")


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", F.get(F.array_sort("runs", _first), F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
