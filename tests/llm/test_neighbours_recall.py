import numpy as np

from loomgraph.llm import neighbours


def test_recall_where_the_leaves_are_many(spark):
    """20,000 unit vectors of 64 dimensions have 16 x 512 leaves."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    counted = spark.sparkContext.accumulator(0)
    for r in neighbours.search(v, v.where("vec_id % 200 = 0"), counted=counted).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = 0
    for i in range(0, 20_000, 200):
        gap = ((x - x[i]).astype(float) ** 2).sum(1)
        gap[i] = np.inf
        assert len(got[i]) == 10
        hit += len(set(np.argsort(gap)[:10].tolist()) & set(got[i]))
    print("recall", hit / 1000, "share measured", counted.value / (100 * 20_000))
    assert hit >= 900


def test_measured_pairs_grow_with_the_visits(spark):
    """In 200 clusters, 8 x 25 times the rows of a query's cluster are enough, however many vectors there are."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(200, 32)) * 5
    share = {}
    for n in (5_000, 20_000):
        x = middle[np.arange(n) % 200] + rng.normal(size=(n, 32))
        v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
        counted = spark.sparkContext.accumulator(0)
        asked = v.where("vec_id % 100 = 0")
        got = {}
        for r in neighbours.search(v, asked, counted=counted).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        hit = 0
        for i in range(0, n, 100):
            gap = ((x - x[i]) ** 2).sum(1)
            gap[i] = np.inf
            hit += len(set(np.argsort(gap)[:10].tolist()) & set(got[i]))
        share[n] = counted.value / (n * n / 100)
        print("recall", hit / (n / 10), "share measured", share[n])
        assert hit >= 0.9 * n / 10
    assert share[20_000] < 0.05


def test_pairs_in_blocks_are_those_of_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(1)
    leaves = np.stack([rng.integers(0, 9, 60), 9 + rng.integers(0, 9, 60), 18 + rng.integers(0, 9, 60)], axis=1)
    visits = [rng.choice(27, 7, replace=False) for _ in range(20)]
    asked = np.repeat(np.arange(20), 7)
    want = [(i, r) for i, v in enumerate(visits) for r in range(60) if set(v) & set(leaves[r])]
    for size in (1, 50, 10_000):
        monkeypatch.setattr(neighbours, "BLOCK_PAIRS", size)
        got = [(int(i), int(r)) for q, rows in neighbours.visited_pairs(asked, np.concatenate(visits), leaves) for i, r in zip(q, rows)]
        assert got == want
