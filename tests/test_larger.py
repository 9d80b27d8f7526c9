"""What a step's work grows with, on small graphs whose hubs or repeats are many."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import lineage
from loomgraph.operators import patterns as P


def _graph(spark, seed, n=60, m=90, star=150):
    """A random graph with loops and repeated lines, two hubs with leaves, one of them shared, and a node alone."""
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += edges[:10] + [(0, 1000 + k) for k in range(star)] + [(1, 1000 + k) for k in range(star // 2)] + [(2, 2000 + k) for k in range(star)] + [(2000, 2000)]
    ids = sorted({x for e in edges for x in e} | {9999})
    nodes = spark.createDataFrame([(i, i % 3) for i in ids], "id long, label int")
    return nodes, G.arcs_of(spark.createDataFrame(edges, "src long, dst long"))


def test_twins_have_the_egos_of_their_own_walks(spark):
    for seed, radius in ((1, 1), (2, 2), (3, 3)):
        nodes, arcs = _graph(spark, seed)
        egos = G.ego(nodes, arcs, radius)
        want = sorted(map(tuple, egos.collect()))
        assert sorted(map(tuple, G.split_ego(nodes, arcs, radius, 20).collect())) == want
        sizes = sorted((r.center, r.depth, len(r.nodes)) for r in G.layers(egos, radius).collect())
        assert sorted(map(tuple, G.layer_sizes(nodes, arcs, radius, 20).collect())) == sizes


def test_leaves_of_a_hub_are_walked_from_once(spark):
    """3,000 leaves of a hub: their 9 million pairs are neither listed for layers nor dealt over a square of
    750 by 750 keys, into which 4.5 million rows were copied before."""
    leaves = spark.range(1, 3_001)
    nodes = leaves.select("id", F.lit(1).alias("label")).union(spark.createDataFrame([(0, 0)], "id long, label int"))
    arcs = G.arcs_of(leaves.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))).distinct()
    of = G.twins(nodes, arcs)
    assert G.twin_reach(arcs, of, 2, 4).count() == 3_000 + 1 + 1 + 3_000 and of.select("twin").distinct().count() == 2
    (hub,) = G.hubs_of(arcs, "src", 4).collect()
    assert hub.parts == 28
    assert {(r.depth, r.n_nodes) for r in G.layer_sizes(nodes, arcs, 2, 4).where("center > 0").collect()} == {(1, 1), (2, 2_999)}


def test_common_neighbours_are_summed_by_tiles(spark):
    """Ids over three blocks, many common neighbours: the sums of a plain loop; pairs never meet as rows."""
    rng = random.Random(4)
    edges = sorted({(rng.randrange(2_300), -1 - rng.randrange(5)) for _ in range(1_500)} | {(5, 5)})
    arcs = G.arcs_of(spark.createDataFrame(edges, "src long, dst long"))
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want = {}
    for of in near.values():
        for u in of:
            for v in of:
                if u < v:
                    want[u, v] = want.get((u, v), 0) + 1 / len(of)
    found = G.resource_allocation(arcs)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = {(r.u, r.v): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_texts_are_made_once_a_shape(spark):
    """1,000 chains of three nodes: two shapes are written out, not 3,000 egos, and all radii come from one pass."""
    nodes = spark.range(3_000).select("id", F.lit(1).alias("label"))
    arcs = P.ordered_arcs(spark.range(3_000).where("id % 3 < 2").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.col("id").alias("seq")))
    shapes = P.shaped(nodes, P.found_ego(nodes, arcs, 2), arcs, [1, 2])
    assert shapes.select("radius", "shape").distinct().count() == 4
    found, keys, paths = P.learnt_paths(nodes, arcs, 2)
    assert sorted((r.pattern_id, r.frequency, r.center_degree) for r in found.collect()) == [(0, 2_000, 1), (1, 1_000, 2)]
    assert sorted(map(tuple, keys.collect())) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert sorted((r.radius, r.id, tuple(r.path)) for r in paths.collect()) == [(1, 0, (1, 1)), (1, 1, (1, 1)), (2, 0, (1, 1, 1))]


def test_an_ego_over_several_batches():
    """Egos whose rows are cut anywhere into batches give the same rows."""
    rows = pa.table({"center": pa.array([1, 1, 1, 2, 3, 3], pa.int64()), "node": pa.array([1, 7, 9, 2, 3, 9], pa.int64()), "depth": pa.array([0, 1, 1, 0, 0, 1], pa.int32()), "label": pa.array([4, 5, 6, 4, None, 6], pa.int32()), "out": pa.array([[7, 9, 50], [9, 9], [9], None, [], [3, 1]], pa.list_(pa.int64()))})
    want = [{"center": 1, "near": [[1, 2], [0, 2, 2], [0, 1, 1, 2]]}, {"center": 2, "near": [[]]}, {"center": 3, "near": [[1], [0]]}]
    for size in (1, 2, 4, 6):
        got = [r for b in P._met(iter(rows.to_batches(size))) for r in b.to_pylist()]
        assert [{"center": r["center"], "near": [sorted(m["near"]) for m in r["members"]]} for r in got] == want


def test_layers_are_counted_in_parts_of_the_arcs(spark, monkeypatch):
    """More arcs make more parts, not larger ones; the counts are those of the listed egos."""
    nodes, arcs = _graph(spark, 5)
    want = sorted(map(tuple, G.ego(nodes, arcs, 2).groupBy("center", "depth").count().collect()))
    monkeypatch.setattr(lineage, "TASK_ROWS", 20)
    found = G.layer_counts(nodes, arcs, 2)
    assert sorted(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() == -(-arcs.count() // 20) > 4


def test_a_hub_is_copied_no_faster_than_it_grows(spark, monkeypatch):
    """Of two stars, one ten times the other, the parts stay 8 while rows fit: they were 28 and 87 at a limit of 4."""
    rows = spark.createDataFrame([(3_000,), (30_000,), (2_000_000,)], "n long")
    assert [r.p for r in rows.select(G.parts_of(F.col("n"), 4).alias("p")).collect()] == [8, 8, 20]
    copied, plain = [], G.dealt

    def counted(*args):
        out = plain(*args)
        copied.append((args[0].count(), out.count()))
        return out

    monkeypatch.setattr(G, "dealt", counted)
    leaves = spark.range(1, 3_001)
    nodes = leaves.select("id", F.lit(1).alias("label")).union(spark.createDataFrame([(0, 0)], "id long, label int"))
    arcs = G.arcs_of(leaves.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    found = G.split_ego(nodes, arcs, 2, 4)
    assert found.count() == 3_001**2
    assert all(out <= 8 * rows for rows, out in copied)


def test_tiles_shuffle_an_array_once_a_block(spark, monkeypatch):
    """Twenty separate copies of a dense graph: arrays reach the tiles of their own blocks alone, so copies do
    not grow with the table; the sums are those of every small block and of pairs made few at a time."""
    rng = random.Random(8)
    edges = {(100 * k + rng.randrange(60), -1 - 10 * k - rng.randrange(6)) for k in range(20) for _ in range(250)}
    arcs = G.arcs_of(spark.createDataFrame(sorted(edges), "src long, dst long"))

    def run():
        return {(r.u, r.v): r.score for r in G.resource_allocation(arcs).collect()}

    want = run()
    monkeypatch.setattr(G, "BLOCK_ARCS", 300)
    for at_once in (1_000, 7):
        monkeypatch.setattr(G, "PAIRS_AT_ONCE", at_once)
        got = run()
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    chunks = G.tile_sums(arcs, arcs.count(), 100_000)
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_egos_of_radius_1_are_shuffled_three_times(spark):
    """Loops, repeats, hubs, an end and a centre without a label: the members of listed egos, by fewer exchanges."""
    nodes, arcs = _graph(spark, 6)
    nodes = nodes.where("id % 7 <> 3")
    arcs = P.ordered_arcs(arcs.where("src <= dst").withColumn("seq", F.monotonically_increasing_id()))

    def shapes(rows):
        return sorted((r.center, [(m.i, m.node, m.depth, m.label, sorted(m.near)) for m in r.members]) for r in rows.collect())

    found = P.first_rows(nodes, arcs)
    assert shapes(found) == shapes(P.ego_rows(nodes, P.found_ego(nodes, arcs, 1), arcs))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = P.first_rows(nodes, arcs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 3
