import random

import pytest

from loomgraph.operators import bits as B
from loomgraph.operators import cells as C
from loomgraph.operators import generator as gen
from loomgraph.operators import growth as W
from loomgraph.operators import numbering as N
from loomgraph.operators import patterns as P


@pytest.fixture(scope="module")
def learnt():
    """70 patterns, so sets of two words; some have no key at radius 1, one has a key without partners."""
    rng = random.Random(11)
    ids = sorted(rng.sample(range(1000), 70))
    compat = {1: {}, 2: {a: set() for a in ids}}
    for r, share in ((1, 0.2), (2, 0.8)):
        known = ids if r == 2 else ids[:60]
        compat[r] = {a: set() for a in known}
        for k, a in enumerate(known[:-1]):
            for b in known[k + 1 : -1]:
                if rng.random() < share:
                    compat[r][a].add(b), compat[r][b].add(a)
    return gen.Learnt({a: a % 5 for a in ids}, {a: rng.randint(1, 6) for a in ids}, {a: rng.randint(2, 5) for a in ids}, compat, 2, 2)


@pytest.fixture(scope="module")
def dictionary(spark, learnt):
    patterns = spark.createDataFrame([(a, learnt.label[a], learnt.frequency[a], learnt.degree[a]) for a in learnt.label], "id long, label int, frequency long, degree long")
    keys = spark.createDataFrame([(r, a) for r, of in learnt.compat.items() for a in of], "radius int, a long")
    pairs = spark.createDataFrame([(r, a, b) for r, of in learnt.compat.items() for a, bs in of.items() for b in bs], "radius int, a long, b long")
    return B.from_pairs(patterns, keys, pairs, 2)


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), k) for k in rng.sample(range(10_000), 900)]
    frame = spark.createDataFrame(rows, "run int, pos int").repartition(7)
    assert sorted((r.number, r.run, r.pos) for r in N.numbered(frame, ["run", "pos"]).collect()) == [(k, *r) for k, r in enumerate(sorted(rows))]
    got = sorted((r.run, r.number, r.pos) for r in N.numbered_within(frame, "run", ["pos"]).collect())
    assert got == [(g, k, p) for g in range(4) for k, p in enumerate(sorted(p for r, p in rows if r == g))]
    assert N.numbered_within(frame.limit(0), "run", ["pos"]).count() == 0


def test_paths_give_the_pairs_without_listing_them(spark):
    rng = random.Random(4)
    rows = {(r, k, tuple(rng.randrange(3) for _ in range(r + 1))) for r in (1, 2) for k in range(40) for _ in range(rng.randrange(4))}
    paths = spark.createDataFrame([(r, k, list(p)) for r, k, p in rows], "radius int, id long, path array<int>")
    keys = spark.createDataFrame([(r, k) for r in (1, 2) for k in range(40)], "radius int, a long")
    patterns = spark.createDataFrame([(k, 1, 1, 1) for k in range(40)], "id long, label int, frequency long, degree long")
    d = B.from_paths(patterns, keys, paths, 2)
    want = {(r, k, m) for r, k, p in rows for q, m, o in rows if r == q and k != m and p == o[::-1]}
    every = keys.join(patterns.selectExpr("id as b"))
    assert {tuple(r) for r in B.allowed_pairs(every, d).select("radius", "a", "b").collect()} == want == {tuple(r) for r in P.pairs_by_path(paths).collect()}
    assert d.profiles.select("radius", "profile").distinct().count() == len({(r, frozenset(p for q, m, p in rows if (q, m) == (r, k))) for r in (1, 2) for k in range(40)})
    pairs = spark.createDataFrame([(r, a, b) for r, a, b in want], "radius int, a long, b long")
    asked = spark.createDataFrame([(a, b) for a in range(10) for b in range(a + 1, 40)], "a long, b long")
    scores = {(r.a, r.b): r.score for r in C.pattern_scores(pairs).collect() if r.a < 10}
    assert {(r.a, r.b): r.score for r in B.partner_scores(asked, d).collect()} == pytest.approx(scores)


def state(spark, learnt, dictionary, runs):
    """The runs' cells and arcs as tables; `fresh` are all settled cells."""
    full, sets = B.full_set(dictionary)
    cells = [(k, (k << 32) + c, run.settled.index(c) if c in run.pattern else None, run.pattern.get(c), run.want.get(c, 0), full, c in run.pattern) for k, run in enumerate(runs) for c in range(len(run.domain))]
    near = [((k << 32) + c, (k << 32) + v) for k, run in enumerate(runs) for c in range(len(run.domain)) for v in run.near[c]]
    return W.State(spark.createDataFrame(cells, "run long, cell long, placed long, pattern long, target long, domain string, fresh boolean"), spark.createDataFrame(near, "src long, dst long"), sets)


def same(s, dictionary, runs):
    sets = {}
    for r in B.members(s.sets, dictionary).collect():
        sets.setdefault(r.domain, set()).add(r.id)
    cells = {(r.run, r.cell - (r.run << 32)): r for r in s.cells.collect()}
    near = sorted((r.src, r.dst) for r in s.near.collect())
    for k, run in enumerate(runs):
        mine = {c: r for (q, c), r in cells.items() if q == k}
        assert sorted(mine) == list(range(len(run.domain)))
        assert {c: r.pattern for c, r in mine.items() if r.placed is not None} == run.pattern
        assert sorted(run.settled, key=lambda c: mine[c].placed) == run.settled
        assert {c: sets.get(mine[c].domain, set()) for c in run.frontier} == {c: set(run.domain[c]) for c in run.frontier}
        assert [e for e in near if e[0] >> 32 == k] == sorted(((k << 32) + u, (k << 32) + v) for u in range(len(run.near)) for v in run.near[u])


def test_waves_equal_the_plain_loop_on_twenty_seeds(spark, learnt, dictionary):
    runs = []
    for seed in range(20):
        rng, run = random.Random(seed), gen.Run(learnt, seed)
        for k in range(9):
            run.new_cell(rng.randrange(k) if k else None)
        u, v = rng.sample(range(9), 2)
        if v not in run.near[u]:
            run.join(u, v)
        for c in rng.sample(range(9), 5):
            run.settle(c, rng.choice(run.domain[c]))
        runs.append(run)
    s = state(spark, learnt, dictionary, runs)
    waves = s.cells.selectExpr("run", "4L as allowance").distinct()
    for run in runs:
        run.propagate(list(run.settled), 4)
    s, n = W.propagated(s, waves, dictionary, 50)
    assert n > 1 and any(len(run.settled) > 5 for run in runs) and any(len(run.domain) > 9 for run in runs)
    same(s, dictionary, runs)


def test_grown_graphs_equal_those_of_the_plain_loop(spark, learnt, dictionary):
    seeds = [0, 1, 3, 6]
    runs = spark.createDataFrame([(k, seed, learnt.target) for k, seed in enumerate(seeds)], "run long, seed long, target long")
    plain = [gen.Run(learnt, seed).grow() for seed in seeds]
    s = W.grow(runs, dictionary, learnt.cap)
    same(s, dictionary, plain)
    labels, edges = W.exported(s, dictionary)
    for k, run in enumerate(plain):
        rows = run.rows()
        assert [(r.id, r.label) for r in labels.where(f"run = {k}").orderBy("id").collect()] == list(zip(rows.id, rows.label))
        assert sorted((r.src, r.dst) for r in edges.where(f"run = {k}").collect()) == sorted((i, v) for i, larger in zip(rows.id, rows.larger) for v in larger)
