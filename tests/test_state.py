import random

import pytest

from loomgraph.operators import cells, generator, matching
from loomgraph.sources import folders


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CELLS = "run int, cell int, pos int, pattern int, label int, domain array<int>"


def test_empty_set_prunes_all_and_missing_key_nothing(spark):
    state = frame(spark, [(1, 1, 1, 1, 1, None), (1, 2, 2, None, None, [1, 2, 3]), (1, 3, 3, 2, 2, None), (1, 4, 4, None, None, [3, 1])], CELLS)
    keys = frame(spark, [(1, 1)], "radius int, a int")
    compat = frame(spark, [], "radius int, a int, b int")

    def domains(edges):
        near = frame(spark, edges + [(b, a) for a, b in edges], "src int, dst int")
        return {r.cell: r.domain for r in cells.pruned(state, near, keys, compat, 2).collect()}

    assert domains([(1, 2), (3, 4)]) == {2: [], 4: [3, 1]}


@pytest.mark.parametrize(("budget", "slots"), [(1, [1, 1, 1]), (3, [1, 1, 1]), (10, [1, 1, 3])])
def test_allocation_matches_the_plain_one(spark, budget, slots):
    centers = frame(spark, [(1, k, k, d) for k, d in enumerate((1, 2, 5))], "run int, cell int, pos int, degree int")
    got = {r.cell: r.slots for r in cells.allocated(centers, frame(spark, [(1, budget)], "run int, budget int")).collect()}
    assert [got[k] for k in range(3)] == slots == generator.allocate([1, 2, 5], budget)


def test_no_budget_allocates_nothing(spark):
    centers = frame(spark, [(1, 1, 1, 3)], "run int, cell int, pos int, degree int")
    assert cells.allocated(centers, frame(spark, [(1, 0)], "run int, budget int")).count() == 0


def test_rounds_equal_the_greedy_pass(spark):
    rng = random.Random(7)
    for _ in range(3):
        stubs = {k: rng.randint(1, 3) for k in range(9)}
        pairs = [(1, u, v, rng.choice([0.0, 0.5, 1.0])) for u in range(9) for v in range(u + 1, 9) if rng.random() < 0.6]
        left, want = dict(stubs), set()
        for _, u, v, _ in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
            if left[u] and left[v]:
                left[u], left[v] = left[u] - 1, left[v] - 1
                want.add((u, v))
        got = matching.greedy(frame(spark, pairs, "run int, u int, v int, score double"), frame(spark, list(stubs.items()), "cell int, stubs long"))
        assert {(r.u, r.v) for r in got.collect()} == want


def test_no_pairs_match_nothing(spark):
    assert matching.greedy(frame(spark, [], "run int, u int, v int, score double"), frame(spark, [], "cell int, stubs long")).count() == 0


def test_export_drops_open_cells_loops_and_repeats(spark):
    state = frame(spark, [(1, 7, 2, 1, 5, None), (1, 8, 1, 1, 6, None), (1, 9, 3, None, None, [1])], CELLS)
    near = frame(spark, [(7, 8), (8, 7), (7, 8), (7, 7), (7, 9), (9, 7)], "src int, dst int")
    labels, edges = cells.exported(state, near)
    assert {(r.id, r.label) for r in labels.collect()} == {(0, 6), (1, 5)}
    assert [(r.src, r.dst) for r in edges.collect()] == [(0, 1)]
    bad = frame(spark, [(1, 7, 1, 1, None, None)], CELLS)
    with pytest.raises(Exception, match="no label"):
        cells.exported(bad, near)[0].collect()


def test_folder_of_graphs_resumes(spark, tmp_path):
    training, out = tmp_path / "in", tmp_path / "out"
    training.mkdir()
    for k in (1, 2):
        (training / f"graphedges{k}").write_text("\n".join(f"{i} {(i + 1) % 8}" for i in range(8)))
        (training / f"graphlabels{k}").write_text("\n".join(f"{i} {i % 3 + k}" for i in range(8)))
    resume = str(tmp_path / "state" / "next")
    assert folders.resume_index(spark, resume) == 1
    folders.save_index(spark, resume, 2)
    assert folders.resume_index(spark, resume) == 2
    assert generator.generate_folder(spark, str(training), str(out), resume) == [2]
    assert folders.resume_index(spark, resume) == 1 and not (out / "graphedges1").exists()
    ids = [int(line.split()[0]) for line in (out / "graphlabels2").read_text().splitlines()]
    assert ids == list(range(len(ids)))
    for line in (out / "graphedges2").read_text().splitlines():
        u, v = map(int, line.split())
        assert u < v < len(ids)
    (training / "graphedgesx").write_text("")
    with pytest.raises(ValueError):
        folders.last_index(spark, str(training))
