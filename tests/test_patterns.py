"""Egos, colours, canonical forms and patterns against a plain loop."""

import random
from collections import defaultdict

import pytest

from loomgraph.operators import patterns as P


def wrap(x):
    return (x + 2**31) % 2**32 - 2**31


def plain_forms(labels, edges, radius, rounds=2):
    """{center: (text, label, degree, discovered)} node by node."""
    near = defaultdict(list)
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    out = {}
    for center in labels:
        depth = {center: 0}
        queue = [center]
        for u in queue:
            for v in near[u] if depth[u] < radius else ():
                if v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
        colour = {v: wrap(wrap(31 * (31 + depth[v])) + labels[v]) for v in queue}
        inside = {v: [w for w in near[v] if w in depth] for v in queue}
        for _ in range(rounds):
            new = {}
            for v in queue:
                h = 1
                for c in sorted(colour[w] for w in inside[v]):
                    h = wrap(31 * h + c)
                new[v] = wrap(wrap(31 * (31 + colour[v])) + h)
            colour = new
        order = sorted(queue, key=lambda v: (colour[v], depth[v], labels[v], queue.index(v)))
        at = {v: i for i, v in enumerate(order)}
        text = ";".join(f"({at[v]}:c={colour[v]},d={depth[v]},l={labels[v]}→{sorted(at[w] for w in inside[v])})" for v in order)
        out[center] = (text, labels[center], sum(d == 1 for d in depth.values()), queue)
    return out


@pytest.fixture(scope="module")
def graph():
    """A hub, triangles, loops, repeated edges and nodes without edges."""
    rng = random.Random(31)
    edges = [(0, k) for k in range(1, 30)] + [(rng.randrange(45), rng.randrange(45)) for _ in range(60)]
    edges += edges[3:6] + [(7, 7), (44, 45), (45, 44)]
    rng.shuffle(edges)
    return {k: rng.randrange(3) for k in range(48)}, edges


def frames(spark, labels, edges):
    nodes = spark.createDataFrame(sorted(labels.items()), "id int, label int").repartition(3)
    lines = spark.createDataFrame([(u, v, k) for k, (u, v) in enumerate(edges)], "src int, dst int, seq long")
    return nodes, P.ordered_arcs(lines.repartition(3))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_forms_equal_the_plain_loop(spark, graph, radius):
    want = plain_forms(*graph, radius)
    nodes, arcs = frames(spark, *graph)
    egos = P.found_ego(nodes, arcs, radius).cache()
    got = {r.center: (r.canonical, r.center_label, r.center_degree) for r in P.canonical_forms(nodes, egos, arcs).collect()}
    assert got == {c: w[:3] for c, w in want.items()}
    rows = {r.center: [m.node for m in r.members] for r in P.ego_rows(nodes, egos, arcs).collect()}
    assert rows == {c: w[3] for c, w in want.items()}
    by_text = defaultdict(list)
    for c, w in want.items():
        by_text[w[0]].append(c)
    found = {r.canonical: (r.pattern_id, r.frequency) for r in P.extract_patterns(nodes, arcs, radius).collect()}
    assert found == {t: (min(c), len(c)) for t, c in by_text.items()}


def test_ranked_places(spark, graph):
    want = plain_forms(*graph, 2)
    got = defaultdict(list)
    for r in P.ranked_ego(*frames(spark, *graph), 2).collect():
        got[r.center].append((r.depth, r["rank"], r.node))
    assert {c: [v for _, _, v in sorted(rows)] for c, rows in got.items()} == {c: w[3] for c, w in want.items()}


def test_a_hub_leans_on_few(spark):
    """Of 3,000 arcs of a hub none is in its own list, and every arc is in exactly one."""
    labels = dict.fromkeys(range(3_001), 0)
    edges = [(0, k) for k in range(1, 3_001)] + [(k, k + 1) for k in range(1, 200)]
    nodes, arcs = frames(spark, labels, edges)
    lists = {r.id: r.out or [] for r in P.leaning(nodes, arcs).collect()}
    assert lists[0] == [] and max(map(len, lists.values())) <= 3
    assert sorted(tuple(sorted((u, v))) for u, out in lists.items() for v in out) == sorted(edges)


def test_empty_graphs_and_no_rounds(spark):
    nodes, arcs = frames(spark, {3: 1, 9: 1}, [(3, 9)])
    assert P.extract_patterns(nodes.limit(0), arcs.limit(0), 2).count() == 0
    text = {r.center: r.canonical for r in P.canonical_forms(nodes, P.found_ego(nodes, arcs, 1), arcs, rounds=0).collect()}
    assert set(text.values()) == {"(0:c=962,d=0,l=1→[1]);(1:c=993,d=1,l=1→[0])"}
    alone = P.extract_patterns(nodes, arcs.limit(0), 1).collect()
    assert [(r.pattern_id, r.frequency, r.center_degree, r.canonical[-5:]) for r in alone] == [(3, 2, 0, "1→[])")]
