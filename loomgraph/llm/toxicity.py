"""Toxicity by class-conditional Kneser-Ney bigram models."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, WORD_RE, map_columns, table

#: Labelled rows per class that the classifier is fitted on, the least by hash of doc_id and text.
FIT_ROWS = 3_000
DISCOUNT = 0.75
#: Deviations by which a count must lie off what the classes share before a class has its own; the
#: one of least loss on folds that the model was not fitted on is taken.
SIGMAS = (3.0, 5.0)
#: Folds of the fitted rows.
FOLDS = 5
#: Words of a text that count by themselves, besides the mean of all: a few bad words tell, however long the text.
PEAKS = 2
STRIP = ".,;:!?\"'()[]"


def tokens(text: str | None) -> list[str]:
    return [w.strip(STRIP) for w in WORD_RE.findall((text or "").translate(UPPER))]


@dataclass
class Model:
    """Ids of the words that two or more fitted texts hold (0: all others, and the start), both classes'
    word probabilities, their bigrams' own parts by key, the backoff weights, and the calibration."""

    ids: dict[str, int]
    unigram: np.ndarray
    keys: np.ndarray
    own: np.ndarray
    backoff: np.ndarray
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(1 + PEAKS))
    shift: float = 0.0

    def encode(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        return np.fromiter((self.ids.get(w, 0) for w in found), np.int64, len(found))

    def probabilities(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """P(w | v) under the ordinary and the toxic model."""
        key = v * self.unigram.shape[1] + w
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.own[:, at], 0.0) + self.backoff[:, v] * self.unigram[:, w]

    def evidence(self, w: np.ndarray) -> np.ndarray:
        """Of ln P(word | toxic) - ln P(word | ordinary), each after its left neighbour: the mean of all words and
        the PEAKS largest, in falling order; 0 for those that the text is too short for."""
        out = np.zeros(1 + PEAKS)
        if len(w):
            p = np.log(self.probabilities(np.r_[0, w[:-1]], w))
            ratio = p[1] - p[0]
            out[0] = ratio.mean()
            top = np.sort(np.partition(ratio, -PEAKS)[-PEAKS:] if len(w) > PEAKS else ratio)[::-1]
            out[1 : 1 + len(top)] = top
        return out

    def score(self, text: str | None) -> float:
        z = self.evidence(self.encode(text)) @ self.slopes + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _kept(counts: np.ndarray, group: np.ndarray, groups: int, lower: np.ndarray, sigmas: float) -> np.ndarray:
    """The discounted relative frequencies of both classes' counts within their groups.

    `lower` is what the next lower order gives either class for each entry. Where the toxic count lies
    within `sigmas` deviations of the part of the pooled one that this lets expect, the pooled count is
    dealt to the classes as expected; where it lies off, each class has its own. Every count gives
    up DISCOUNT, pooled or own; a pooled count of 1 gives up all.
    """
    pooled = counts.sum(0)
    less = np.where(pooled <= 1, 0.0, pooled - DISCOUNT)
    totals = np.stack([np.bincount(group, n, groups) for n in counts])
    weight = totals[:, group] * lower
    both = weight.sum(0)
    both = np.where(both > 0, both, 1.0)
    expected = pooled * weight[1] / both
    off = np.abs(counts[1] - expected) >= sigmas * np.sqrt(expected + 1)
    out = np.empty(counts.shape)
    for c in (0, 1):
        total = np.maximum(1.0, totals[c])
        dealt = np.where(off, 0.0, lower[c] / both)
        rest = np.bincount(group, pooled * dealt, groups)
        left = 1 - np.bincount(group, np.where(off, counts[c], 0.0), groups) / total
        scale = np.divide(left, rest, out=np.zeros(groups), where=rest > 0)[group]
        out[c] = np.where(off, np.maximum(counts[c] - DISCOUNT, 0) / total[group], less * dealt * scale)
    return out


def _coded(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words in order, and each text as their numbers."""
    seen: dict[str, int] = {}
    # A text's words are dropped as soon as they have their numbers.
    coded = [np.fromiter((seen.setdefault(w, len(seen)) for w in tokens(t)), np.int32) for t in texts]
    names = sorted(seen)
    place = np.empty(len(names), np.int32)
    place[[seen[w] for w in names]] = np.arange(len(names))
    return names, [place[c] for c in coded]


def _fit(coded: list[np.ndarray], labels: np.ndarray, n_words: int, sigmas: float) -> tuple[Model, np.ndarray]:
    """Both classes' Kneser-Ney models over one vocabulary, and the place of each of the n_words in it.

    The lowest order is shared: a word's part of all distinct left neighbours, in either class. Each
    higher order discounts its counts, and what they give up goes to the next lower one, so that
    every history's probabilities sum to 1. Expressions too rare to tell the classes apart have
    the pooled counts in both.
    """
    # A text that occurs several times in a class tells no more than one.
    once = list({(c.tobytes(), int(y)): (c, int(y)) for c, y in zip(coded, labels)}.values())
    df = np.zeros(n_words, np.int64)
    for c, _ in once:
        df[np.unique(c)] += 1
    place = np.where(df >= 2, np.cumsum(df >= 2), 0)
    size = int((df >= 2).sum()) + 1
    each = [[], []]
    for c, y in once:
        if len(c):
            w = place[c]
            each[y].append(np.r_[0, w[:-1]] * size + w)
    each = [np.unique(np.concatenate(e) if e else np.empty(0, np.int64), return_counts=True) for e in each]
    keys = np.union1d(each[0][0], each[1][0])
    pairs = np.zeros((2, len(keys)))
    for c, (k, n) in enumerate(each):
        pairs[c, np.searchsorted(keys, k)] = n
    del each, once
    v, w = keys // size, keys % size
    shared = np.bincount(w, minlength=size) + 1.0
    shared /= shared.sum()
    words = np.stack([np.bincount(w, n, size) for n in pairs])
    # The start and the words outside may not occur; any weight serves for a count of 0.
    words[:, words.sum(0) == 0] = 1e-9
    own = _kept(words, np.zeros(size, np.int64), 1, np.stack([shared, shared]), sigmas)
    unigram = own + (1 - own.sum(1, keepdims=True)) * shared
    part = _kept(pairs, v, size, unigram[:, w], sigmas)
    backoff = 1 - np.stack([np.bincount(v, x, size) for x in part])
    some = part.any(0)
    if not some.any():
        return Model({}, unigram, np.array([-1]), np.zeros((2, 1)), backoff), place
    return Model({}, unigram, keys[some], part[:, some], backoff), place


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and shift of the weighted logistic regression with a light ridge, by Newton steps that are halved
    while they do not lessen the loss."""
    one = np.c_[x, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], 0.1), 0.001]

    def loss(a: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (one @ a))).sum() + (ridge * a * a).sum() / 2)

    a = np.zeros(one.shape[1])
    least = loss(a)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(one @ a, -30, 30)))
        h = (one * (weight * p * (1 - p))[:, None]).T @ one + np.diag(ridge)
        step = np.linalg.solve(h, one.T @ (weight * (p - y)) + ridge * a)
        while abs(step).max() >= 1e-8 and loss(a - step) > least:
            step = step / 2
        if abs(step).max() < 1e-8:
            break
        a = a - step
        least = loss(a)
    return a


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The logistic regression on the columns of x without those whose slopes would be negative, so that no
    larger ratio lowers a score."""
    scale = x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    used = np.arange(x.shape[1])
    while True:
        a = _logistic(x[:, used] / scale[used], y, weight)
        if not len(used) or a[:-1].min() >= 0:
            break
        used = np.delete(used, a[:-1].argmin())
    slopes = np.zeros(x.shape[1])
    slopes[used] = a[:-1] / scale[used]
    return slopes, float(a[-1])


def train(rows: list[tuple[str | None, int]], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fits on all rows; the choice among SIGMAS and the calibration come from FOLDS folds that each leave
    their texts out.

    A row of class k counts in the calibration as the stands_for[k] labelled rows it was drawn from,
    so that the scores keep the labels' class shares when a class is sampled.
    """
    texts = [t or "" for t, _ in rows]
    y = np.array([t for _, t in rows], float)
    names, coded = _coded(texts)

    def whole(sigmas: float) -> Model:
        model, place = _fit(coded, y, len(names), sigmas)
        model.ids = {names[i]: int(place[i]) for i in np.flatnonzero(place)}
        return model

    if not len(y) or y.min() == y.max():
        model = whole(SIGMAS[0])
        model.shift = 5.0 if len(y) and y[0] else -5.0
        return model
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    fold = np.array([hash_of(t) % FOLDS for t in texts])

    def evidence(sigmas: float) -> np.ndarray:
        x = np.zeros((len(y), 1 + PEAKS))
        for k in range(FOLDS):
            part, place = _fit([c for c, f in zip(coded, fold) if f != k], y[fold != k], len(names), sigmas)
            for i in np.flatnonzero(fold == k):
                x[i] = part.evidence(place[coded[i]])
        return x

    every = {sigmas: evidence(sigmas) for sigmas in SIGMAS}
    sigmas = min(SIGMAS, key=lambda g: _loss(every[g], y, weight))
    model = whole(sigmas)
    model.slopes, model.shift = _calibrate(every[sigmas], y, weight)
    return model


def _loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The calibrated log loss of the columns of x."""
    if not len(x):
        return 0.0
    slopes, shift = _calibrate(x, y, weight)
    z = np.where(y == 1, 1, -1) * (x @ slopes + shift)
    return float((weight * np.logaddexp(0, -z)).sum())


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of the labelled rows that are not held out, at most `rows` of each class.

    The calibration is to the class shares of all of them. Of several labels or texts of one doc_id the
    smallest counts, so that reruns agree.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    known = known.where(~F.coalesce(held_out(), F.lit(True)))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    stands_for = tuple(max(1.0, count.get(k, 0) / rows) for k in (0, 1))
    take = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    some = docs.select("doc_id", "text").join(F.broadcast(take[0].union(take[1])), "doc_id")
    drawn = some.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).repartition(1).sortWithinPartitions("doc_id")

    def fit(batches):
        found = [r for b in batches for r in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(found, stands_for))], pa.binary())], names=["model"])

    # The drawn rows are few by FIT_ROWS; one task fits them, and only the model meets the driver.
    found = drawn.mapInArrow(fit, "model binary").first()
    return pickle.loads(found["model"]) if found else train([])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null, empty and wordless texts have no evidence and score by the shift alone; texts are scored whole; repeated
    rows and ids each have their row; an empty table gives none; other columns are not read. The
    model is bounded by the fitted rows, so it is broadcast. A null doc_id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def batch(ids, held, texts):
        found = [shared.value.score(t) for t in texts]
        return ids, held, found, [int(s >= threshold) for s in found]

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return map_columns(rows, ["doc_id", "held_out", "text"], batch, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs(text, ...) that score below the threshold, all columns as they are; null and empty
    texts score by the shift alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def ordinary(texts):
        return texts.map(lambda t: shared.value.score(t) < threshold)

    return docs.where(ordinary("text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored, learning from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fitted(docs, table(spark, sf_dir, "labels")))
