"""Katz backoff bigram scoring with Good-Turing discounts, over partitioned count tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Lookup, mix, pack, unpack, word_codes
from .common import sliced, stored, table

#: Counts up to this are discounted.
K = 5
#: Most words whose counts every task holds; rarer words' counts are joined to their tokens.
FREQUENT = 500_000
#: Tokens whose pairs one task counts.
PART_TOKENS = 2_000_000
#: Bytes of texts that are cut into words at a time.
BLOCK = 1 << 23
#: Distinct words by block that a task holds before it passes on their counts.
HELD_WORDS = 1_500_000
#: Tokens of rare words that are dealt together.
RARE_ROWS = 1_000_000
#: Documents whose sums meet in one block.
RANGE = 1 << 12
#: The place of the end of a text among the frequent words; it is also the history of a first word.
END = 0
#: Codes of rare words have this bit, so that they differ from the places of frequent ones.
RARE = np.uint64(1 << 63)


def discounts(counts: dict[int, int], k: int = K) -> list[float]:
    """Good-Turing ratios d_0..d_k (d_0 unused) from counts of counts, renormalised as Katz does so
    that counts above k stay whole. Where the counts of counts give no ratio inside (0, 1), they are
    smoothed by a line through their logarithms (of slope -2 if there are too few of them)."""
    known = [(r, counts[r]) for r in range(1, k + 2) if counts.get(r)]
    slope = -2.0
    if len(known) > 1:
        slope = min(-1.1, float(np.polyfit(np.log([r for r, _ in known]), np.log([n for _, n in known]), 1)[0]))
    n1 = counts.get(1, 0)
    whole = (k + 1) * counts.get(k + 1, 0) / n1 if n1 else 0.0
    out = [1.0]
    for r in range(1, k + 1):
        smooth = ((r + 1) / r) ** (slope + 1)
        turing = (r + 1) * counts.get(r + 1, 0) / (r * counts[r]) if counts.get(r) else 0.0
        ratio = turing if 0 < turing < 1 else smooth
        d = (ratio - whole) / (1 - whole) if whole < 1 else ratio
        out.append(d if 0 < d < 1 else ratio)
    return out


class Unigrams:
    """Katz's lowest order: discounted counts; what they free belongs to the one unseen word.

    If nothing is freed (no count up to K), the total counts one more, which frees that one.
    """

    def __init__(self, total: int, of_counts: dict[int, int]):
        self.ratio = np.array(discounts(of_counts))
        freed = sum((1 - self.ratio[r]) * r * of_counts.get(r, 0) for r in range(1, K + 1))
        self.total = total + (freed <= 0)
        self.unseen = (freed if freed > 0 else 1.0) / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.ratio[np.where(c <= K, c, 0)] * c / self.total, self.unseen)


def unigram_counts(docs: DataFrame) -> DataFrame:
    """(code, c) of the words of docs(text)."""

    def part(batches):
        held, rows = [], 0

        def merged():
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "c"])

        for batch in batches:
            for some in sliced(batch, BLOCK):
                held.append(np.unique(word_codes(some.column(0))[0], return_counts=True))
                rows += len(held[-1][0])
                if rows > HELD_WORDS:
                    yield merged()
                    rows = 0
        if held:
            yield merged()

    return docs.select("text").mapInArrow(part, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def _bucket(c):
    return F.when(c < 4096, c).otherwise(4096 + F.floor(F.log2(c) * 64))


class Frequent:
    """The frequent words' places (the end's is END), training counts and, for histories that are too
    large for one task, over how many tasks their pairs are dealt."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, ends: int, total: int, parts: int):
        self.lookup, self.parts = Lookup(codes), parts
        self.counts = np.r_[ends, counts]
        self.spread = np.minimum(parts, 1 + 2 * parts * self.counts // max(1, total)).astype(np.uint64)

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Places of frequent words, marked codes of the others."""
        at = self.lookup.find(codes)
        return np.where(at >= 0, (at + 1).astype(np.uint64), codes | RARE)

    def spread_of(self, prev: np.ndarray) -> np.ndarray:
        rare = prev >= RARE
        return np.where(rare, np.uint64(1), self.spread[np.where(rare, np.uint64(0), prev).astype(np.int64)])

    def task(self, prev: np.ndarray, word: np.ndarray) -> np.ndarray:
        return ((mix(prev) % np.uint64(self.parts) + mix(word + np.uint64(7)) % self.spread_of(prev)) % np.uint64(self.parts)).astype(np.int32)


def _dealt(base: int, prev, word, cw, doc, n, frequent: Frequent):
    """One block per task of the tokens' (prev, word, its count, doc, times), given by prev and word."""
    task = frequent.task(prev, word)
    order = np.argsort(task.astype(np.uint16) if frequent.parts <= 1 << 16 else task, kind="stable")
    cuts = np.searchsorted(task[order], np.arange(frequent.parts + 1)) if frequent.parts <= len(task) else np.flatnonzero(np.diff(task[order], prepend=-1, append=-1))
    tasks, blocks = [], []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if a == b:
            continue
        at = order[a:b]
        head = np.flatnonzero(np.diff(prev[at], prepend=~prev[at[:1]]))
        w = word[at]
        rare = w >= RARE
        short = np.where(rare, np.uint64(0xFFFFFFFF), w).astype(np.uint32)
        tasks.append(int(task[at[0]]))
        blocks.append(pack(np.array([base], np.int64), prev[at][head], np.diff(np.r_[head, len(at)]).astype(np.uint32), short, w[rare], cw[at][rare].astype(np.uint32), doc[at], n[at].astype(np.uint32)))
    return pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array(blocks, pa.binary())], names=["task", "block"])


def _tokens(some, base: int, frequent: Frequent, rare: bool):
    """Distinct (prev, word, doc, times) of the slice's frequent or rare words, by prev and word; doc is
    a text's number and whether it is learnt from."""
    codes, bounds = word_codes(some.column("text"))
    train = ~np.asarray(some.column("held").to_numpy(zero_copy_only=False), bool)
    size = np.diff(bounds)
    place = frequent.lookup.find(codes).astype(np.int64) + 1
    other = np.flatnonzero(place == 0)
    # Rare words count on from the frequent ones, in the order of their codes.
    found, own = np.unique(codes[other] | RARE, return_inverse=True)
    place[other] = len(frequent.counts) + own
    word = np.insert(place, bounds[1:], END)
    prev = np.r_[END, word[:-1]]
    prev[np.arange(len(size)) + bounds[1:] - size] = END
    doc = np.repeat((np.arange(len(size)) << 1) | train, size + 1)
    some = (word >= len(frequent.counts)) == rare
    prev, word, doc = prev[some], word[some], doc[some]
    names = np.r_[np.arange(len(frequent.counts), dtype=np.uint64), found]
    width, low = int(len(names)).bit_length(), int(len(size)).bit_length() + 1
    if 2 * width + low <= 64:
        key, n = np.unique((prev.astype(np.uint64) << np.uint64(width + low)) | (word << low | doc).astype(np.uint64), return_counts=True)
        prev, word, doc = key >> np.uint64(width + low), (key >> np.uint64(low)) & np.uint64((1 << width) - 1), key & np.uint64((1 << low) - 1)
    else:
        (prev, word, doc), n = np.unique(np.stack([prev, word, doc]), axis=1, return_counts=True)
    return names[prev], names[word], doc.astype(np.uint32), n


def _pairs(docs: DataFrame, shared, rare: bool) -> DataFrame:
    """The pairs whose word is frequent as dealt blocks, or those of rare words as rows."""

    def part(batches):
        for batch in batches:
            for some in sliced(batch, BLOCK):
                at = some.column("row")[0].as_py()
                prev, word, doc, n = _tokens(some, at, shared.value, rare)
                if rare:
                    cols = [word.view(np.int64), prev.view(np.int64), doc.astype(np.int64) + 2 * at, n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["word", "prev", "doc", "n"])
                else:
                    yield _dealt(at, prev, word, n, doc, n, shared.value)

    return docs.select("row", "text", "held").mapInArrow(part, "word long, prev long, doc long, n int" if rare else "task int, block binary")


def _dealt_rare(rows: DataFrame, shared) -> DataFrame:
    def part(batches):
        held, size = [], 0

        def deal():
            word, prev, doc, n, c = (np.concatenate([h.column(k).to_numpy() for h in held]) for k in ("word", "prev", "doc", "n", "c"))
            word, prev = word.view(np.uint64), prev.view(np.uint64)
            order = np.lexsort((doc, word, prev))
            held.clear()
            return _dealt(0, prev[order], word[order], c[order], doc[order], n[order], shared.value)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RARE_ROWS:
                yield deal()
                size = 0
        if size:
            yield deal()

    return rows.mapInArrow(part, "task int, block binary")


def _counted(blocks: DataFrame, shared, uni: Unigrams) -> DataFrame:
    """The pair table, one row per task: counts of counts, what its share of each spread history
    frees by count and covers of the unigrams, and the tokens under their pairs."""

    def part(batches):
        f = shared.value
        found = [unpack(b) for batch in batches for b in batch.column(1).to_pylist()]
        if not found:
            return
        heads, own = np.unique(np.concatenate([x[1] for x in found]), return_inverse=True)
        p = np.repeat(own, np.concatenate([x[2] for x in found]))
        word, rare, rare_c = (np.concatenate([x[k] for x in found]) for k in (3, 4, 5))
        doc = np.concatenate([x[0][0] + (x[6] >> 1).astype(np.int64) for x in found])
        n = np.concatenate([x[7] for x in found])
        times_learnt = n * np.concatenate([x[6] & 1 for x in found])
        del found
        is_rare = word == 0xFFFFFFFF
        kinds, own = np.unique(rare, return_inverse=True)
        word = word.astype(np.int64)
        word[is_rare] = len(f.counts) + own
        cw = f.counts[np.where(is_rare, 0, word)]
        cw[is_rare] = rare_c
        # Each block came in this order, so the sort merges runs.
        key = p * (len(f.counts) + len(kinds)) + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(np.r_[first, len(key)])
        c = np.add.reduceat(times_learnt[order].astype(np.int64), first)
        at = order[first]
        head, pair_cw = p[at], cw[at]
        of = [int((c == r).sum()) for r in range(1, K + 2)]
        spread = f.spread_of(heads) > 1
        sums = np.array([np.bincount(head, (c == r) & spread[head], len(heads)) for r in range(1, K + 1)] + [np.bincount(head, uni.p(pair_cw) * ((c > 0) & spread[head]), len(heads))])
        block = pack(heads, np.diff(np.r_[np.searchsorted(head, np.arange(len(heads))), len(head)]).astype(np.uint32), c.astype(np.uint64), pair_cw.astype(np.uint32), is_rare[at].astype(np.uint8), times.astype(np.uint32), doc[order], n[order])
        split = np.flatnonzero(spread)
        yield pa.RecordBatch.from_arrays(
            [pa.array([of], pa.list_(pa.int64())), pa.array([heads[split].view(np.int64)], pa.list_(pa.int64())), pa.array([sums[:, split].T.ravel()], pa.list_(pa.float64())), pa.array([block], pa.binary())],
            names=["of", "heads", "sums", "block"],
        )

    return blocks.mapInArrow(part, "of array<long>, heads array<long>, sums array<double>, block binary")


def pair_logs(heads, per_head, c, cw, ratio, uni: Unigrams, f_counts, split: dict):
    """(log10 probability, history) of each pair; the pairs stand by history.

    A history whose pairs all count more than K frees nothing; it counts one more, which frees that.
    """
    head = np.repeat(np.arange(len(heads)), per_head)
    low = np.where(c <= K, c, 0)
    total = np.bincount(head, c, len(heads))
    freed = np.bincount(head, np.where(c <= K, (1 - ratio[low]) * c, 0.0), len(heads))
    covered = np.bincount(head, uni.p(cw) * (c > 0), len(heads))
    for i, h in enumerate(heads.tolist()):
        if h in split:
            total[i], freed[i], covered[i] = split[h]
    none = (freed <= 0) & (total > 0)
    total, freed = total + none, np.where(none, 1.0, freed)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.log10(np.where(c <= K, ratio[low], 1.0) * c / total[head])
        alpha = np.where(total > 0, np.log10(freed / total) - np.log10(np.maximum(1 - covered, uni.unseen)), 0.0)
        return np.where(c > 0, seen, alpha[head] + np.log10(uni.p(cw)))


def _scored(pairs: DataFrame, shared, uni: Unigrams, ratio: np.ndarray, split, base_of: tuple[int, int]) -> DataFrame:
    """Per document its score, and the known tokens and base of its rare words.

    Each row of the pair table gives a block of sums per range of documents; a range's blocks meet.
    """
    total, kinds = base_of

    def part(batches):
        f = shared.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                heads, per_head, c, cw, rare, times, doc, n = unpack(block)
                logs = np.repeat(pair_logs(heads, per_head, c.astype(np.int64), cw.astype(np.int64), ratio, uni, f.counts, split.value), times) * n
                is_rare = np.repeat(rare, times) * n
                at, docs = pd.factorize(doc, sort=True)
                cw = np.repeat(cw, times)
                base = np.bincount(at, is_rare * np.log10((cw + 0.5) / (total + 0.5 * (kinds + 1))))
                sums = docs, np.bincount(at, logs), np.bincount(at, is_rare * (cw > 0)).astype(np.uint32), base
                ranges = docs // RANGE
                cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(docs)]
                blocks = [pack(np.diff(sums[0][a:b], prepend=0), *(x[a:b] for x in sums[1:])) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ranges[cuts[:-1]], pa.int64()), pa.array(blocks, pa.binary())], names=["range", "block"])

    def meet(batches):
        found = [unpack(b) for batch in batches for b in batch.column(1).to_pylist()]
        if found:
            at, docs = pd.factorize(np.concatenate([np.cumsum(x[0]) for x in found]))
            score, known, base = (np.bincount(at, np.concatenate([x[k] for x in found])) for k in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(score), pa.array(known.astype(np.int64)), pa.array(base)], names=["row", "score", "known", "base"])

    blocks = pairs.select("block").mapInArrow(part, "range long, block binary").repartition("range")
    return blocks.mapInArrow(meet, "row long, score double, known long, base double")


def _documents(docs: DataFrame, shared, base_of: tuple[int, int]) -> DataFrame:
    """Per document its row number, tokens, and the known tokens and base of its frequent words."""
    total, kinds = base_of
    kind = docs.schema["doc_id"].dataType

    def part(batches):
        f = shared.value
        for batch in batches:
            for some in sliced(batch, BLOCK):
                codes, bounds = word_codes(some.column("text"))
                place = f.lookup.find(codes) + 1
                size = np.diff(bounds)
                doc = np.repeat(np.arange(len(size)), size)[place > 0]
                c = f.counts[place[place > 0]]
                log = np.log10((np.r_[c, f.counts[END]] + 0.5) / (total + 0.5 * (kinds + 1)))
                known = np.bincount(doc, c > 0, len(size)).astype(np.int64) + (f.counts[END] > 0)
                cols = [some.column("doc_id"), some.column("held"), some.column("row"), pa.array(size + 1), pa.array(known), pa.array(np.bincount(doc, log[:-1], len(size)) + log[-1])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "row", "n_tokens", "known0", "base0"])

    return docs.select("doc_id", "row", "text", "held").mapInArrow(part, f"doc_id {kind.simpleString()}, held_out boolean, row long, n_tokens long, known0 long, base0 double")


def score(docs: DataFrame, held) -> DataFrame:
    """Per row of docs(doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where `held` is false (null is false). A null or empty text has the end
    token only; repeated rows, null ids included, each get a result; an empty table gives none;
    other columns are not read. Without training rows every probability is 1.

    Words are told apart by 64-bit codes. Counts of the FREQUENT most frequent words reach every
    task, those of rarer words are joined to their tokens. Tokens are dealt by history into the
    tasks of the pair table (a large history over several), packed, and stored under their pairs;
    scoring reads that table once and sums by document. `docs` must give the same rows in the
    same partitions each time it is read, as files do.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"), F.monotonically_increasing_id().alias("row"))
    words = stored(unigram_counts(docs.where("not held")), "unigrams")
    ends = docs.where("not held").count()
    seen = {r["b"]: (r["n"], r["s"]) for r in words.groupBy(_bucket(F.col("c")).alias("b")).agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect()}
    total, kinds = sum(s for _, s in seen.values()) + ends, sum(n for n, _ in seen.values()) + (ends > 0)
    of_counts = {r: seen.get(r, (0, 0))[0] + (ends == r) for r in range(1, K + 2)}
    least, room = None, FREQUENT
    for b in sorted(seen, reverse=True):
        room -= seen[b][0]
        if room < 0:
            break
        least = b
    hot = words.where(_bucket(F.col("c")) >= (least if least is not None else 1 << 40)).orderBy("code").toArrow()
    parts = max(1, -(-total // PART_TOKENS))
    frequent = Frequent(hot["code"].to_numpy().view(np.uint64), hot["c"].to_numpy(), ends, total, parts)
    shared = spark.sparkContext.broadcast(frequent)
    uni = Unigrams(total, of_counts)
    # Rare words meet their counts by the code as it is, without the mark.
    tail = words.where(_bucket(F.col("c")) < (least if least is not None else 1 << 40)).select((F.col("code").bitwiseOR(F.lit(-(1 << 63)))).alias("word"), "c").groupBy("word").agg(F.sum("c").alias("c"))
    rare = _pairs(docs, shared, True).join(tail, "word", "left").select("word", "prev", "doc", "n", F.coalesce("c", F.lit(0)).alias("c"))
    blocks = _pairs(docs, shared, False).unionByName(_dealt_rare(rare, shared)).repartitionById(parts, F.col("task"))
    pairs = stored(_counted(blocks, shared, uni), "pairs")
    of = np.zeros(K + 1, np.int64)
    spread: dict[int, np.ndarray] = {}
    for r in pairs.select("of", "heads", "sums").collect():
        of += np.array(r["of"])
        for h, s in zip(r["heads"], np.array(r["sums"]).reshape(-1, K + 1)):
            spread[h] = spread.get(h, 0) + s
    ratio = np.array(discounts(dict(enumerate(of.tolist(), 1))))
    lost = (1 - ratio[1:]) * np.arange(1, K + 1)
    split = spark.sparkContext.broadcast({h: (float(frequent.counts[h]), float((s[:K] * lost).sum()), float(s[K])) for h, s in spread.items()})
    sums = _scored(pairs, shared, uni, ratio, split, (total, kinds))
    out = _documents(docs, shared, (total, kinds)).join(sums, "row")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known0") + F.col("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base0") + F.col("base")).alias("base_score"), "score")


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored, learning from those whose crc32(doc_id) mod 5 is not 1."""
    return score(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1)
