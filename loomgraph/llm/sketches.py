"""Document fingerprints: invertible Bloom lookup sketches of paragraphs that are subtracted and peeled."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BLANK, buffer, mix, string_codes
from .common import sliced, table

#: Cells of the first sketch, in HASHES parts of equal size; a paragraph has one cell in each part.
CELLS, HASHES = 24, 3
#: One in so many words ends a paragraph by what its last bytes are, where neither a line nor a sentence ends.
WORDS_A_CUT = 16
#: Documents that are sketched at a time.
GROUP = 4096
ODD = np.uint64(0x9E3779B97F4A7C15)
ENDS = np.zeros(256, bool)
ENDS[[ord("."), ord("!"), ord("?")]] = True


def paragraphs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the paragraphs, n + 1 bounds of each text's keys) of a string column; a null is empty.

    A paragraph ends before a word that follows a line break, a word with a full stop, exclamation or
    question mark at its end, or a word chosen by its last eight bytes; so an edit moves no other cut.
    The paragraphs put together are the text. The k-th copy of one has a key of its own.
    """
    raw, at = buffer(column)
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    blank = BLANK[raw]
    start = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    stop = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    place = np.searchsorted(stop, start, "right") - 1
    start, place = start[place >= 0], place[place >= 0]
    end, text = stop[place], np.searchsorted(at, start, "right") - 1
    start, end, text = (a[end > at[text]] for a in (start, end, text))
    lines = np.flatnonzero(raw == 10)
    cut = ENDS[raw[end - 1]] | (np.searchsorted(lines, start) > np.searchsorted(lines, end))
    last = np.zeros(len(start), np.uint64)
    for k in range(1, 9):
        last = (last << np.uint64(8)) | np.where(end - k >= at[text], raw[np.maximum(end - k, 0)], 0).astype(np.uint64)
    cut |= mix(last + ODD) % np.uint64(WORDS_A_CUT) == 0
    head = np.union1d(at[:-1][at[1:] > at[:-1]], start[cut])
    bounds = np.searchsorted(head, at)
    digests = mix(string_codes(raw, head))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    order = np.lexsort((digests, owner))
    new = np.r_[True, (digests[order][1:] != digests[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
    copy = np.empty(len(order), np.uint64)
    copy[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    with np.errstate(over="ignore"):
        return mix(digests + copy * ODD), bounds


def _places(keys: np.ndarray, owner: np.ndarray, cells: int) -> list[np.ndarray]:
    part = cells // HASHES
    with np.errstate(over="ignore"):
        return [owner * cells + r * part + (mix(keys + np.uint64(r + 1 + HASHES * cells) * ODD) % np.uint64(part)).astype(np.int64) for r in range(HASHES)]


def _proof(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ ODD).astype(np.uint32)


class Sketches:
    """A table of `cells` cells for each of n texts: how many keys it holds, their sum and their proofs' sum."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count, self.total, self.proof = np.zeros(n * cells, np.int32), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint32)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> list[np.ndarray]:
        """Adds each key to its cells, or takes it away where the sign is -1."""
        places = _places(keys, owner, self.cells)
        with np.errstate(over="ignore"):
            signed, proofs = keys * np.asarray(sign).astype(np.uint64), _proof(keys) * np.asarray(sign).astype(np.uint32)
            for at in places:
                np.add.at(self.count, at, sign)
                np.add.at(self.total, at, signed)
                np.add.at(self.proof, at, proofs)
        return places

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, owners, signs) of what could be taken out, and per text whether nothing is left."""
        keys, owners, signs = [], [], []
        look = np.flatnonzero(np.abs(self.count) == 1)
        with np.errstate(over="ignore"):
            while len(look):
                sign = self.count[look]
                key = self.total[look] * sign.astype(np.uint64)
                pure = self.proof[look] == _proof(key) * sign.astype(np.uint32)
                look, sign, key = look[pure], sign[pure], key[pure]
                owner = look // self.cells
                # A key that is alone in several cells is taken from the first of them.
                alone = np.ones(len(look), bool)
                for at in _places(key, owner, self.cells):
                    alone &= ~((at < look) & (self.count[at] == sign) & (self.total[at] == key * sign.astype(np.uint64)) & (self.proof[at] == _proof(key) * sign.astype(np.uint32)))
                key, owner, sign = key[alone], owner[alone], sign[alone]
                if not len(key):
                    break
                keys.append(key), owners.append(owner), signs.append(sign)
                touched = np.unique(np.concatenate(self.add(key, owner, -sign)))
                look = touched[np.abs(self.count[touched]) == 1]
        left = ((self.count != 0) | (self.total != 0) | (self.proof != 0)).reshape(-1, self.cells).any(axis=1)
        empty = np.empty(0, np.int64)
        return np.concatenate([empty.astype(np.uint64), *keys]), np.concatenate([empty, *owners]), np.concatenate([empty, *signs]), ~left

    def texts(self) -> list[str]:
        """The cells of each text as base64: counts, sums, proofs."""
        rows = zip(*(a.reshape(-1, self.cells) for a in (self.count, self.total, self.proof)))
        return [base64.b64encode(b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in row)).decode() for row in rows]


def fingerprints(found: tuple[np.ndarray, np.ndarray]) -> list[str]:
    keys, bounds = found
    s = Sketches(len(bounds) - 1, CELLS)
    s.add(keys, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
    return s.texts()


def differences(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, text numbers, signs) of the keys in one version only, 1 for the left.

    The versions' sketches are subtracted and peeled; where that fails both are made twice as large.
    """
    n = len(left[1]) - 1
    sides = [(keys, np.repeat(np.arange(n), np.diff(bounds)), sign) for (keys, bounds), sign in ((left, 1), (right, -1))]
    todo, cells, found = np.arange(n), CELLS, []
    while len(todo):
        number = np.full(n, -1)
        number[todo] = np.arange(len(todo))
        s = Sketches(len(todo), cells)
        for keys, owner, sign in sides:
            some = number[owner] >= 0
            s.add(keys[some], number[owner[some]], sign)
        keys, owner, sign, whole = s.peel()
        done = whole[owner]
        found.append((keys[done], todo[owner[done]], sign[done]))
        todo, cells = todo[~whole], cells * 2
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def likeness(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of the paragraphs of both versions that they have in common; 1 for two empty texts."""
    total = np.diff(left[1]) + np.diff(right[1])
    apart = np.bincount(differences(left, right)[1], minlength=len(total))
    return np.where(total > 0, (total - apart) / np.maximum(total, 1), 1.0)


def _groups(batch: pa.RecordBatch):
    for some in sliced(batch):
        for k in range(0, some.num_rows, GROUP):
            yield some.slice(k, GROUP)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, fingerprint of every row; null and empty texts have no paragraphs. Repeated
    rows stay as they are, further columns are left out."""
    kind = dict(docs.dtypes)["doc_id"]

    def part(batches):
        for batch in batches:
            for some in _groups(batch):
                found = paragraphs(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.diff(found[1])), pa.array(fingerprints(found), pa.string())], ["doc_id", "n_paragraphs", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {kind}, n_paragraphs long, fingerprint string")


def compare(versions: DataFrame) -> DataFrame:
    """doc_id, likeness, removed, added of versions(doc_id, text, other): the digests of the paragraphs
    that only the text or only the other has, each in ascending order; null texts are empty."""
    kind = dict(versions.dtypes)["doc_id"]

    def part(batches):
        for batch in batches:
            for some in _groups(batch):
                one, two = paragraphs(some.column(1)), paragraphs(some.column(2))
                keys, owner, sign = differences(one, two)
                columns = [some.column(0), pa.array(likeness(one, two))]
                for side in (1, -1):
                    key, own = keys[sign == side].view(np.int64), owner[sign == side]
                    order = np.lexsort((key, own))
                    columns.append(pa.ListArray.from_arrays(np.searchsorted(own[order], np.arange(some.num_rows + 1)).astype(np.int32), key[order]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "likeness", "removed", "added"])

    return versions.select("doc_id", "text", "other").mapInArrow(part, f"doc_id {kind}, likeness double, removed array<long>, added array<long>")


LOWEST = -(1 << 63)


def followed(docs: DataFrame) -> DataFrame:
    """bucket, extra, doc_id, text in stretches of ascending doc_id, each with the row after its last as an extra.

    Stretches are cut at approximate quantiles of doc_id, a few for each shuffle partition, so no task
    sorts more than its part; the first row of a stretch goes to the one before it as well, the very
    first to the last. Only the cuts and the smallest ids reach the driver. Null ids come first, equal
    ids by text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / (4 * parts) for k in range(1, 4 * parts)]
    found = ids.agg(F.percentile_approx("id", shares, 80 * parts)).first()[0] or []
    cuts = np.unique(np.array(found, np.int64))

    def bucket_of(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, values, "right")

    def least(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            where = bucket_of(values)
            order = np.lexsort((values, where))
            first = np.flatnonzero(np.r_[True, np.diff(where[order]) > 0])[: len(values)]
            yield pa.RecordBatch.from_arrays([pa.array(where[order][first]), pa.array(values[order][first])], ["bucket", "id"])

    heads = sorted((r.bucket, r.id) for r in ids.mapInArrow(least, "bucket long, id long").groupBy("bucket").agg(F.min("id").alias("id")).collect())
    first_ids = np.array([i for _, i in heads], np.int64)
    before = np.array([heads[k - 1][0] for k in range(len(heads))], np.int64)

    def place(batches):
        for batch in batches:
            values = np.array(batch.column(0).fill_null(LOWEST))
            at = np.minimum(np.searchsorted(first_ids, values), len(heads) - 1)
            copies = np.flatnonzero(first_ids[at] == values)
            rows = np.r_[np.arange(len(values)), copies]
            some = batch.take(pa.array(rows)) if len(copies) else batch
            where = np.r_[bucket_of(values), before[at[copies]]]
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.arange(len(rows)) >= len(values)), some.column(0), some.column(1)], ["bucket", "extra", "doc_id", "text"])

    dealt = docs.mapInArrow(place, "bucket long, extra boolean, doc_id long, text string")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")


def _pairs(batches):
    """(ids, texts, texts of the next rows) of what `followed` gives."""
    held = None
    for batch in batches:
        for some in _groups(batch):
            ids, texts, after = [], [], []
            for extra, doc_id, text in zip(*(some.column(k).to_pylist() for k in (1, 2, 3))):
                if held is not None:
                    ids.append(held[0]), texts.append(held[1]), after.append(text)
                held = None if extra else (doc_id, text)
            yield ids, texts, after


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the next one's beginning, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to each other and to the
    next document, the one of the next larger doc_id (after the last: the first)."""

    def part(batches):
        for ids, texts, after in _pairs(batches):
            new = [edited(t, a) for t, a in zip(texts, after)]
            one, two, three = (paragraphs(pa.array(c, pa.string())) for c in (texts, new, after))
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in new]
            columns = ids, list(map(len, texts)), digests, fingerprints(one), fingerprints(two), likeness(one, two), likeness(one, three)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return followed(table(spark, sf_dir, "documents")).mapInArrow(part, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
