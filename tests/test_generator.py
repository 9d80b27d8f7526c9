from loomgraph.operators import generator, graph, patterns


def test_allocation():
    assert generator.allocate([1, 2, 5], 0) == [0, 0, 0]
    assert generator.allocate([1, 2, 5], 1) == [1, 1, 1]
    assert generator.allocate([1, 2, 5], 10) == [1, 1, 3]
    assert generator.allocate([0, 4], 2) == [0, 2]


def test_empty_set_and_missing_key_differ():
    learnt = generator.Learnt({1: 1, 2: 2, 3: 3}, {1: 1, 2: 1, 3: 1}, {1: 1, 2: 1, 3: 1}, {1: {1: set(), 2: {3}}}, 6, 3)
    for pattern, left in ((1, []), (2, []), (3, [1, 2, 3])):
        run = generator.Run(learnt, 1)
        run.new_cell()
        run.new_cell(0)
        run.settle(0, pattern)
        run.propagate([0], 0)
        assert run.domain[1] == (left if pattern != 2 else [3])
        assert (1 in run.pattern) == (pattern == 2) and 1 not in run.want


def test_generated_graphs(spark):
    ring = [(i, (i + 1) % 12, i) for i in range(12)] + [(0, 6, 12), (3, 9, 13)]
    nodes = spark.createDataFrame([(i, i % 3 + 1) for i in range(12)], "id int, label int")
    arcs = patterns.ordered_arcs(spark.createDataFrame(ring, "src int, dst int, seq long"))
    learnt = generator.learn(nodes, arcs, radius=2)
    assert set(learnt.compat) == {1, 2} and learnt.target == 24 and sum(learnt.frequency.values()) == 12
    graphs = generator.generate(spark, learnt, [1, 2, 3])
    rows = graphs.collect()
    assert sorted(map(str, rows)) == sorted(map(str, generator.generate(spark, learnt, [1, 2, 3]).collect()))
    ids = {}
    for r in rows:
        ids.setdefault(r.seed, []).append(r.id)
        assert r.label in (1, 2, 3) and all(v > r.id for v in r.larger)
    assert all(sorted(v) == list(range(len(v))) for v in ids.values()) and len(ids) == 3
    assert all(r.dst in ids[r.seed] for r in generator.generated_edges(graphs).collect())


def test_forms_tell_shapes_apart(spark):
    nodes = spark.createDataFrame([(i, 1) for i in range(7)], "id int, label int")
    edges = spark.createDataFrame([(0, 1, 0), (1, 2, 1), (2, 0, 2), (3, 4, 3), (4, 5, 4)], "src int, dst int, seq long")
    arcs = patterns.ordered_arcs(edges)
    found = {r.pattern_id: (r.frequency, r.center_degree) for r in patterns.extract_patterns(nodes, arcs, 1).collect()}
    assert found == {0: (3, 2), 3: (2, 1), 4: (1, 2), 6: (1, 0)}
    pairs, keys = patterns.compatibility(nodes, arcs, 1)
    assert keys.count() == 4 and {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in (0, 3, 4) for b in (0, 3, 4) if a != b}
    assert graph.expansion_cap(nodes, arcs).first().cap == 3
