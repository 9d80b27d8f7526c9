import duckdb
import pytest

from loomgraph.operators import graph
from loomgraph.plans.queries import ORACLES, QUERIES
from loomgraph.sources.text import load_graph, write_graph

SF = "/root/testdata/sf0.01"


#: Two million rows take the Python comparison too long; the query runs on the smaller tables.
SMALL = {"parts_score"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    db, folder = duckdb.connect(), SF.replace("0.01", "0.001") if name in SMALL else SF
    for t in ("orders", "customer", "region", "nation", "supplier", "lineitem", "part"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, folder).toPandas()
    want = db.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_text_rules(spark, tmp_path):
    (tmp_path / "e").write_text("1 2 # c\n2\t3 x\n// n\n\n4\n")
    (tmp_path / "l").write_text("1 5\n1 6\n9 7")
    nodes, edges = load_graph(spark, str(tmp_path / "e"), str(tmp_path / "l"))
    assert sorted((r.id, r.label) for r in nodes.collect()) == [(1, 6), (2, 0), (3, 0), (9, 7)]
    assert edges.count() == 2


def test_blanks_at_both_ends(spark, tmp_path):
    (tmp_path / "e").write_text("\t3 4\n3\t\n \x0b5 6 \t\r\n7 8\t# 9 9")
    _, edges = load_graph(spark, str(tmp_path / "e"), None)
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(3, 4), (5, 6), (7, 8)]


def test_written_graphs_are_sorted(spark, tmp_path):
    nodes = spark.createDataFrame([(k, k % 3) for k in (11, 2, 7, 1, 30)], "id int, label int").repartition(3)
    edges = spark.createDataFrame([(2, 11), (1, 30), (30, 1), (2, 7), (2, 7), (7, 7), (1, 2)], "src int, dst int").repartition(3)
    write_graph(nodes, edges, str(tmp_path))
    lines = {k: [line for f in sorted((tmp_path / k).glob("part-*")) for line in f.read_text().split("\n") if line] for k in ("edges", "labels")}
    assert lines == {"edges": ["1 2", "1 30", "2 7", "2 11"], "labels": ["1 1", "2 2", "7 1", "11 2", "30 0"]}


def test_a_bad_token_fails(spark, tmp_path):
    (tmp_path / "e").write_text("1 x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_graph(spark, str(tmp_path / "e"), None)[1].collect()


def test_cap_guards(spark):
    nodes, arcs = spark.createDataFrame([], "id int, label int"), spark.createDataFrame([], "src int, dst int")
    for p, slack in ((-0.1, 1), (1.1, 1), (0.9, -1)):
        with pytest.raises(ValueError):
            graph.expansion_cap(nodes, arcs, p, slack)
    with pytest.raises(Exception, match="empty"):
        graph.expansion_cap(nodes, arcs).collect()


def test_empty_layers_are_listed(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, label int")
    arcs = graph.arcs_of(spark.createDataFrame([(1, 2)], "src long, dst long"))
    found = {(r.center, r.depth): r.nodes for r in graph.layers(graph.ego(nodes, arcs, 2), 2).collect()}
    assert found == {(1, 1): [2], (1, 2): [], (2, 1): [1], (2, 2): [], (3, 1): [], (3, 2): []}
