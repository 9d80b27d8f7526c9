import math

import numpy as np

from loomgraph.llm import whitening as W

SF = "/root/testdata/sf0.001"


def check(rows, got, dims):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    a = np.array(x, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1].T
    assert len(got) == n * min(dims, 8)
    at = {(r.vec_id, r.component): r for r in got}
    for c in range(min(dims, 8)):
        want = a @ vectors[c] / math.sqrt(values[c])
        mine = np.array([at[i, c + 1].whitened for i, _ in good])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        for (i, _), row in zip(good, x):
            r = at[i, c + 1]
            assert r.n == n and r.deviation == sum((n * p - s) ** 2 for p, s in zip(row, sums)) and abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-8


def test_query_equals_the_eigenvectors_of_the_covariance(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, W.op13_whitening(spark, SF).collect(), len(rows[0][1]))


def test_many_partitions_nulls_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=5) * [9, 5, 3, 2, 1]).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 2.0, 3.0, 4.0]), (1002, [1.0, float("nan"), 2.0, 3.0, 4.0]), (1003, [float("inf")] * 5), (1004, [])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, dims int")
    frame.repartition(70).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k"), spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = W.op13_whitening(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes"), spark.conf.unset("spark.sql.files.openCostInBytes")
    check([r for r in rows if r[1] != []], got, 5)


def test_spaces_by_length_flat_ones_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 7.0]), (3, [2.0]), (None, [2.0, 2.5]), (4, [5.0, 5.0, 5.0]), (5, [5.0, 5.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    models = W.fit(frame)
    got = W.whiten(frame, models, W.identity_errors(frame, models)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted((str(k), c, 3) for k in (1, 2, None) for c in (1, 2))
    assert all(r.identity_error < 1e-9 for r in got)
    assert W.fit(frame.limit(0)) == {} and W.whiten(frame.limit(0), {}, {}).count() == 0


def test_merging_loses_nothing_and_large_deviations_stay_exact():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(500, 6)) * 10.0 ** -np.arange(6)
    parts = [W.Summary.of(p, [0] * 6) for p in np.split(rows, [1, 3, 4, 200, 450])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    assert whole.n == 500 and np.allclose(whole.singular, np.linalg.svd(rows - rows.mean(axis=0))[1], rtol=1e-12)
    m = W.Model(3_000_000, [5, -7], np.zeros(2), np.ones(2), np.eye(2), np.ones(2))
    x = np.array([[900, -400], [10**7, 3]]) + W.BASE
    exact = [sum((m.n * (int(v) - W.BASE) - s) ** 2 for v, s in zip(r, m.sums)) for r in x]
    assert m.deviations(x) == [e if e < 2**63 else None for e in exact]
