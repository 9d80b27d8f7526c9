import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cells as C
from loomgraph.operators import graph as G
from loomgraph.operators import many as S
from loomgraph.operators import patterns as P
from loomgraph.sources import folders
from loomgraph.sources.text import load_graph


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three graphs with triangles, hubs, comments, repeated labels and a file without labels."""
    root, rng = tmp_path_factory.mktemp("graphs"), random.Random(5)
    for k in (1, 2, 7):
        lines = [f"{u} {v} # {u}" for u, v in {(rng.randrange(12), rng.randrange(12)) for _ in range(25)} if u != v]
        (root / f"graphedges{k}").write_text("// a graph\n" + "\n".join(lines) + "\n")
        if k != 7:
            (root / f"graphlabels{k}").write_text("".join(f"{i} {rng.randrange(3)}\n" for i in [*range(12), 3, 3, 40]))
    return str(root)


def test_a_folder_equals_its_graphs(spark, folder):
    nodes, edges = folders.load_folder(spark, folder)
    nodes, edges = nodes.cache(), edges.cache()
    found = S.patterns_by_graph(nodes, edges, 2).collect()
    classes = S.classes_by_graph(nodes, edges, 1).collect()
    assert {r.graph for r in found} == {1, 2, 7}
    for k in (1, 2, 7):
        n, e = load_graph(spark, f"{folder}/graphedges{k}", None if k == 7 else f"{folder}/graphlabels{k}")
        assert sorted(map(tuple, nodes.where(F.col("graph") == k).select("id", "label").collect())) == sorted(map(tuple, n.collect()))
        inside = edges.where(F.col("graph") == k)
        assert [tuple(r) for r in inside.orderBy("seq").select("src", "dst").collect()] == [tuple(r) for r in e.orderBy("seq").select("src", "dst").collect()]
        one = P.extract_patterns(n, P.ordered_arcs(e), 2)
        assert sorted(tuple(r)[1:] for r in found if r.graph == k) == sorted(map(tuple, one.collect()))
        _, _, paths = P.learnt_paths(n, P.ordered_arcs(e), 1)
        out = sorted((tuple(r.path), r["count"]) for r in paths.groupBy("path").count().collect())
        assert sorted((tuple(r.path), r.patterns_out) for r in classes if r.graph == k and r.patterns_out) == out


def test_an_empty_folder(spark, tmp_path):
    nodes, edges = folders.load_folder(spark, str(tmp_path))
    assert nodes.count() == edges.count() == 0
    assert S.patterns_by_graph(nodes, edges, 1).count() == 0


def test_keys_keep_order_and_come_apart(spark):
    rows = [(g, i) for g in (-3, 0, 5) for i in (-(2**31), -1, 0, 7, 2**31 - 1)]
    keyed = spark.createDataFrame(rows, "g int, i int").select("g", "i", S.key(F.col("g"), F.col("i")).alias("k"))
    got = keyed.select("g", "i", "k", S.graph_of(F.col("k")).alias("g2"), S.own_id(F.col("k")).alias("i2")).orderBy("k").collect()
    assert [(r.g, r.i) for r in got] == sorted(rows) == [(r.g2, r.i2) for r in got]


def test_hubs_are_split(spark):
    """A star of 400 and a random graph: the same egos, however far the star is split."""
    rng = random.Random(9)
    edges = {(0, k) for k in range(1, 401)} | {(rng.randrange(401), rng.randrange(401)) for _ in range(300)}
    nodes = spark.createDataFrame([(k, 0) for k in range(402)], "id long, label int")
    arcs = G.arcs_of(spark.createDataFrame(sorted(edges), "src long, dst long"))
    want = sorted(map(tuple, G.ego(nodes, arcs, 2).collect()))
    for limit in (1_000, 40, 7):
        assert sorted(map(tuple, G.split_ego(nodes, arcs, 2, limit).collect())) == want
    empty = spark.createDataFrame([], "src long, dst long")
    assert G.split_ego(nodes, empty, 2).count() == 402


def test_no_key_holds_a_hub(spark):
    """A hub of 5,000 arcs in 50 parts: its 2,500 keys hold about 100 arcs and 100 centres each."""
    arcs = spark.range(5_000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    hubs = spark.createDataFrame([(-1, 50)], "hub long, parts int")
    for by, own, other in (("dst", "col", "row"), ("dst", "row", "col")):
        sizes = [r["count"] for r in G.dealt(arcs, hubs, "src", by, own, other).groupBy("src", "row", "col").count().collect()]
        assert len(sizes) == 2_500 and sum(sizes) == 5_000 * 50
        assert max(sizes) < 2 * sorted(sizes)[1_250]


def test_an_export_broken_off_goes_on(spark, tmp_path, monkeypatch):
    nodes = spark.createDataFrame([(g, i, (g * i) % 3) for g in range(1, 6) for i in range(30)], "graph int, id int, label int").repartition(3)
    edges = spark.createDataFrame([(g, i, (i * g + 1) % 30) for g in range(1, 6) for i in range(30)] + [(1, 4, 2), (1, 2, 4), (1, 2, 4)], "graph int, src int, dst int").repartition(3)
    root, plain, calls = tmp_path / "out", folders.publish, []

    def breaks(*args):
        if len(calls) == 2:
            raise OSError("lost")
        calls.append(args)
        return plain(*args)

    monkeypatch.setattr(folders, "publish", breaks)
    with pytest.raises(OSError):
        folders.write_graphs(nodes, edges, str(root))
    first = {p: p.stat().st_mtime_ns for p in root.glob("graph=*/kind=*/part-*")}
    assert {p.parent.parent.name for p in first} == {"graph=1", "graph=2"}
    monkeypatch.setattr(folders, "publish", plain)
    assert folders.write_graphs(nodes, edges, str(root)) == 3
    assert folders.write_graphs(nodes, edges, str(root)) == 0
    assert all(p.stat().st_mtime_ns == t for p, t in first.items())
    want = {}
    for r in edges.where("src < dst").distinct().collect():
        want.setdefault(r.graph, []).append((r.src, r.dst))
    for g in range(1, 6):
        def read(kind):
            return [tuple(map(int, line.split())) for f in sorted((root / f"graph={g}/kind={kind}").glob("part-*")) for line in f.read_text().splitlines()]

        assert read("edges") == sorted(want[g])
        assert read("labels") == [(i, (g * i) % 3) for i in range(30)]


def test_guards_of_the_cells(spark):
    schema = "run long, cell long, pos long, pattern int, label int, domain array<int>"
    cells = spark.createDataFrame([(1, 1, 1, 2, 5, None), (1, 2, 2, None, None, [1, 3])], schema)
    patterns = spark.createDataFrame([(1, 7), (2, 5), (3, 9)], "id int, label int")

    def take(cell, pattern):
        return sorted(map(tuple, C.collapsed(cells, spark.createDataFrame([(cell, pattern)], "cell long, pattern int"), patterns).collect()))

    assert take(2, 3) == [(1, 1, 1, 2, 5, None), (1, 2, 2, 3, 9, [3])]
    with pytest.raises(Exception, match="not possible"):
        take(2, 2)
    with pytest.raises(Exception, match="is settled"):
        take(1, 2)
    assert C.possible(cells.where("cell = 2")).first().domain == [1, 3]
    with pytest.raises(Exception, match="is settled"):
        C.possible(cells).collect()


def test_a_summary_lists_both_sides(spark):
    nodes = spark.createDataFrame([(1, 4), (2, 5), (3, 6), (4, 7)], "id int, label int")
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 3, 3), (3, 4, 4)], "src int, dst int, seq long")
    text = {r.pattern_id: r.summary for r in P.summaries(nodes, P.ordered_arcs(edges), 2).collect()}
    assert text[1] == (
        "Pattern ID: 1(label=4), Radius: 2, Frequency: 1, CenterDegree: 2\n1-hop nodes: [2(5), 3(6)]\n"
        "  2(5): same-layer → [3(6)], next-layer → []\n  3(6): same-layer → [2(5)], next-layer → [4(7)]\n"
        "2-hop nodes: [4(7)]\n  4(7): same-layer → [], next-layer → []"
    )
