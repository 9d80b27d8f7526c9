"""Whitening of embeddings by singular values merged up a tree of partitions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sliced, table

#: Steps of an entry's whole numbers to 1, and what is added to them.
SCALE, BASE = 1024, 100_000
#: Components that are given.
COMPONENTS = 8
#: Summaries that are merged at a time.
FAN = 8
#: Entries beyond this have no whole number that a double holds exactly.
LARGEST = 2.0**42
SUMMARY = "dims int, slot long, n long, sums array<long>, base array<double>, singular array<double>, vectors array<double>"


@dataclass
class Summary:
    """n rows: exact sums of their whole numbers, mean, and the singular values and right vectors of the centred rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    singular: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, sums: list[int] | None = None) -> Summary:
        mean = rows.mean(axis=0)
        _, singular, vectors = np.linalg.svd(rows - mean, full_matrices=False)
        return cls(len(rows), sums or [], mean, singular, vectors)

    def merge(self, other: Summary) -> Summary:
        """Both row sets as one: their scaled vectors and a row for the means' difference, decomposed anew at full rank."""
        n = self.n + other.n
        gap = other.mean - self.mean
        rows = np.vstack([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, math.sqrt(self.n / n * other.n) * gap])
        _, singular, vectors = np.linalg.svd(rows, full_matrices=False)
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + gap * (other.n / n), singular, vectors)

    def covariance(self) -> np.ndarray:
        rows = self.singular[:, None] * self.vectors
        return rows.T @ rows / self.n

    def row(self, slot: int) -> tuple:
        return len(self.mean), slot, self.n, self.sums, self.mean.tolist(), self.singular.tolist(), self.vectors.ravel().tolist()

    @classmethod
    def from_row(cls, r) -> Summary:
        d = len(r.base)
        return cls(int(r.n), [int(x) for x in r.sums], np.array(r.base, float), np.array(r.singular, float), np.array(r.vectors, float).reshape(-1, d))


def usable(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Whether each vector takes part, and the row numbers of those that do by their length.

    Null and empty vectors and those with an entry that is null, not finite or beyond LARGEST take no part.
    """
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(values) <= LARGEST)
    sums = np.r_[0, np.cumsum(bad)]
    end = np.cumsum(size)
    good = (size > 0) & (sums[end] == sums[end - size])
    return good, {int(d): np.flatnonzero(good & (size == d)) for d in np.unique(size[good])}


def whole_numbers(column: pa.Array, rows: np.ndarray, d: int) -> np.ndarray:
    """floor(1024 * c) + 100000 of the entries of the rows of d entries, as longs."""
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    return np.floor(SCALE * values).astype(np.int64) + BASE


def summarised(vectors: DataFrame, rows_of) -> DataFrame:
    """One Summary per partition and vector length, merged FAN at a time until each length has one.

    rows_of(whole numbers) -> what is summarised. A summary takes as many doubles as the square of its
    length, whatever the number of rows.
    """
    from pyspark import TaskContext

    def part(batches):
        found: dict[int, Summary] = {}
        for batch in batches:
            for some in sliced(batch):
                for d, rows in usable(some.column(0))[1].items():
                    whole = whole_numbers(some.column(0), rows, d)
                    one = Summary.of(rows_of(d, whole), [int(x) for x in (whole - BASE).sum(axis=0)])
                    found[d] = found[d].merge(one) if d in found else one
        slot = TaskContext.get().partitionId()
        rows = [(d, *s.row(slot)[1:]) for d, s in sorted(found.items())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SUMMARY))
    level = vectors.select("embedding").mapInArrow(part, SUMMARY)
    level = cut(level)
    left = level.rdd.getNumPartitions()

    def merged(key, frame):
        found = None
        for r in frame.sort_values("slot").itertuples():
            one = Summary.from_row(r)
            found = one if found is None else found.merge(one)
        return pd.DataFrame([(key[0], *found.row(key[1])[1:])], columns=[f.name for f in schema])

    while left > 1:
        level = level.groupBy("dims", F.floor(F.col("slot") / FAN).alias("up")).applyInPandas(merged, SUMMARY)
        left = math.ceil(left / FAN)
    return level


@dataclass
class Model:
    """The components of the vectors of one length; n and sums are exact."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, s: Summary, components: int) -> Model:
        values = s.singular**2 / s.n
        # Values of rounding alone stand for no direction.
        k = int((values[:components] > values[:1] * (len(s.mean) * 2.0**-50) ** 2).sum()) if s.n > 1 else 0
        vectors = s.vectors[:k] * np.sign(s.vectors[np.arange(k), np.abs(s.vectors[:k]).argmax(axis=1)])[:, None]
        return cls(s.n, s.sums, s.mean, values[:k], vectors, values[:k] / values.sum() if k else values[:0])

    def whitened(self, whole: np.ndarray) -> np.ndarray:
        return ((whole - BASE) - self.mean) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, whole: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S)**2 of each row; None if it is beyond a long."""
        middle = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, middle)]
        shifted = whole - BASE - np.array(middle)
        if (float(np.abs(shifted).max(initial=0)) * self.n + self.n) ** 2 * len(middle) < 2.0**62:
            return ((self.n * shifted - np.array(rest)) ** 2).sum(axis=1).tolist()
        exact = (sum((self.n * x - r) ** 2 for x, r in zip(row, rest)) for row in shifted.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The models of embedding by its length. What reaches the driver is one summary per length."""
    rows = summarised(vectors, lambda d, whole: (whole - BASE).astype(float)).collect()
    return {r.dims: Model.of(Summary.from_row(r), components) for r in rows}


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """By length the largest absolute entry of the whitened rows' covariance less the identity."""
    some = {d: m for d, m in models.items() if len(m.values)}
    if not some:
        return {}
    rows = summarised(vectors.where(F.size("embedding").isin(list(some))), lambda d, whole: some[d].whitened(whole)).collect()
    return {r.dims: float(np.abs(Summary.from_row(r).covariance() - np.eye(len(r.base))).max()) for r in rows}


def whiten(vectors: DataFrame, models: dict[int, Model], errors: dict[int, float]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per usable row and component.

    Vectors of each length are a space of their own. A space of one row, or whose rows do not differ in
    as many directions, has fewer components, in the first case none. Repeated rows count as often as
    they come; further columns are left out. A deviation beyond a long is null.
    """
    kind = dict(vectors.dtypes)["vec_id"]

    def part(batches):
        for batch in batches:
            for some in sliced(batch):
                for d, rows in usable(some.column(1))[1].items():
                    model = models[d]
                    k = len(model.values)
                    whole = whole_numbers(some.column(1), rows, d)
                    columns = [
                        some.column(0).take(pa.array(np.repeat(rows, k))), np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)), np.full(len(rows) * k, model.n),
                        pa.array(model.deviations(whole), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))), model.whitened(whole).ravel(), np.tile(model.explained, len(rows)), np.full(len(rows) * k, errors.get(d, 0.0)),
                    ]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "embedding").mapInArrow(part, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    models = fit(vectors)
    return whiten(vectors, models, identity_errors(vectors, models))
