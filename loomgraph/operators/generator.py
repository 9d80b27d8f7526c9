"""Growing graphs from learnt patterns: collapse, propagation, expansion and wiring.

A run is a chain of single collapses, so it is one task; many seeds run side by side.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders
from . import graph as G
from . import patterns as P

#: Learnt pairs that a run may hold; a larger dictionary is refused rather than broadcast.
MAX_PAIRS = 2_000_000


@dataclass
class Learnt:
    """Patterns in order of id; compat[radius][a] is the set of a's partners, absent for no key."""

    label: dict[int, int]
    frequency: dict[int, int]
    degree: dict[int, int]
    compat: dict[int, dict[int, set[int]]]
    target: int
    cap: int


def allocate(degrees: list[int], budget: int) -> list[int]:
    """Slots per cell: the share by degree, at least 1 and at most half the degree (rounded up),
    what is left by largest remainder, one more each. The minimum can exceed the budget."""
    demand = sum(degrees)
    if demand == 0 or budget <= 0:
        return [0] * len(degrees)
    share = [budget * d / demand for d in degrees]
    most = [(d + 1) // 2 for d in degrees]
    slots = [min(max(1, math.floor(s)), m) for s, m in zip(share, most)]
    surplus = budget - sum(slots)
    open_cells = [i for i in range(len(degrees)) if slots[i] < most[i]]
    for i in sorted(open_cells, key=lambda i: -round(share[i] - slots[i], 12))[: max(0, surplus)]:
        slots[i] += 1
    return slots


@dataclass
class Run:
    learnt: Learnt
    seed: int
    domain: list[list[int]] = field(default_factory=list)
    pattern: dict[int, int] = field(default_factory=dict)
    near: list[list[int]] = field(default_factory=list)
    want: dict[int, int] = field(default_factory=dict)
    frontier: list[int] = field(default_factory=list)
    settled: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.draws = 0
        self.radius = max(self.learnt.compat, default=0)

    def new_cell(self, parent: int | None = None) -> None:
        cell = len(self.domain)
        self.domain.append(list(self.learnt.frequency))
        self.near.append([])
        self.frontier.append(cell)
        if parent is not None:
            self.join(parent, cell)

    def join(self, u: int, v: int) -> None:
        self.near[u].append(v)
        self.near[v].append(u)

    def settle(self, cell: int, pattern: int) -> None:
        self.pattern[cell] = pattern
        self.frontier.remove(cell)
        self.settled.append(cell)

    def entropy(self, cell: int) -> float:
        """To nine places, so that it does not depend on the order of the sum."""
        weights = [self.learnt.frequency[p] for p in self.domain[cell]]
        total = sum(weights)
        return round(math.log(total) - sum(round(w * math.log(w), 9) for w in weights) / total, 9) if len(weights) > 1 else 0.0

    def collapse(self) -> int | None:
        """Settles the first cell of least positive entropy by a weighted draw."""
        open_cells = [(h, i) for i, c in enumerate(self.frontier) if (h := self.entropy(c)) > 0]
        if not open_cells:
            return None
        cell = self.frontier[min(open_cells)[1]]
        sums = np.cumsum([self.learnt.frequency[p] for p in self.domain[cell]])
        pattern = self.domain[cell][int(np.searchsorted(sums, self.draw() * sums[-1]))]
        self.settle(cell, pattern)
        self.want[cell] = self.learnt.degree[pattern]
        return cell

    def draw(self) -> float:
        """The next draw in [0, 1), as `growth.draw` gives it."""
        self.draws += 1
        return zlib.crc32(f"{self.seed}:{self.draws - 1}".encode()) / 2.0**32

    def rings(self, start: int, depth: int, through) -> list[list[int]]:
        """The cells at distance 1..depth, entering only cells that `through` allows."""
        seen, ring, out = {start}, [start], []
        for _ in range(depth):
            ring = list(dict.fromkeys(v for u in ring for v in self.near[u] if v not in seen and through(v)))
            seen.update(ring)
            out.append(ring)
        return out

    def propagate(self, seeds: list[int], cap: int) -> None:
        """Prunes around the seeds; cells with one pattern left settle without a target degree and are the next seeds."""
        while seeds:
            for s in seeds:
                for d, ring in enumerate(self.rings(s, self.radius, lambda v: True), 1):
                    allowed = self.learnt.compat[d].get(self.pattern[s])
                    for c in ring if allowed is not None else ():
                        if c not in self.pattern:
                            self.domain[c] = [p for p in self.domain[c] if p in allowed]
            seeds = [c for c in self.frontier if len(self.domain[c]) == 1]
            for c in seeds:
                self.settle(c, self.domain[c][0])
            if seeds:
                self.expand(seeds, math.ceil(math.sqrt(len(seeds))) * cap - len(self.frontier))

    def expand(self, cells: list[int], budget: int) -> None:
        for cell, n in zip(cells, allocate([self.learnt.degree[self.pattern[c]] for c in cells], budget)):
            for _ in range(n):
                self.new_cell(cell)

    def missing(self, cell: int) -> int:
        return max(0, self.want.get(cell, 0) - len(self.near[cell]))

    def fits(self, cell: int, other: int) -> bool:
        """Whether all settled cells round `cell` go with the other end's pattern, one step further."""
        for k, ring in enumerate(self.rings(cell, self.radius - 1, lambda v: v in self.pattern), 1):
            allowed = self.learnt.compat[k + 1]
            if any(self.pattern[other] not in allowed.get(self.pattern[c], ()) for c in ring):
                return False
        return True

    def score(self, u: int, v: int) -> float:
        one = self.learnt.compat[1]
        both = one.get(self.pattern[u], set()) & one.get(self.pattern[v], set())
        return round(sum(1 / len(one[m]) for m in sorted(both) if one.get(m)), 9)

    def connect(self) -> int:
        """Edges between settled cells that lack some, by score, ties by cell; the rules are tested before the round only."""
        one = self.learnt.compat.get(1, {})
        by_pattern: dict[int, list[int]] = {}
        for c in self.settled:
            if self.missing(c):
                by_pattern.setdefault(self.pattern[c], []).append(c)
        found = []
        for a, cells in by_pattern.items():
            for b in one.get(a, ()):
                found += [(u, v) for u in cells for v in by_pattern.get(b, ()) if u < v and v not in self.near[u] and self.fits(u, v) and self.fits(v, u)]
        made = 0
        for _, u, v in sorted((-self.score(u, v), u, v) for u, v in found):
            if self.missing(u) and self.missing(v):
                self.join(u, v)
                made += 1
        return made

    def grow(self) -> Run:
        target, cap = self.learnt.target, self.learnt.cap
        self.new_cell()
        while len(self.settled) / target < 0.9 and (cell := self.collapse()) is not None:
            self.expand([cell], cap - len(self.frontier))
            self.propagate([cell], cap)
            self.connect()
            self.propagate(list(self.settled), cap)
        self.clean_up(target, cap)
        while (cell := self.collapse()) is not None:
            self.connect()
            self.propagate([cell], 0)
        self.connect()
        return self

    def clean_up(self, target: int, cap: int) -> None:
        while True:
            lacking = [c for c in self.settled if self.missing(c)]
            stubs = sum(map(self.missing, lacking))
            decay = min(1.0, max(0.0, (1.1 - len(self.settled) / target) / 0.1))
            allowance = min(math.ceil(decay * cap), max(0, stubs - len(self.frontier)))
            if (not stubs and not self.frontier) or len(self.settled) >= math.ceil(target * 1.1):
                return
            if not self.frontier and stubs and allowance:
                for c in lacking:
                    for _ in range(min(self.missing(c), allowance)):
                        self.new_cell(c)
                        allowance -= 1
            elif self.connect():
                self.propagate(list(self.settled), allowance)
            elif (cell := self.collapse()) is not None:
                self.connect()
                self.expand([cell], allowance)
                self.propagate([cell], allowance)
            else:
                return

    def rows(self) -> pd.DataFrame:
        """Per settled cell its number in settled order, label and larger neighbours."""
        at = {c: i for i, c in enumerate(self.settled)}
        near = [sorted({at[v] for v in self.near[c] if v in at and at[v] > i}) for c, i in at.items()]
        return pd.DataFrame({"seed": self.seed, "id": list(at.values()), "label": [self.learnt.label[self.pattern[c]] for c in at], "larger": near})


def learn(nodes: DataFrame, arcs: DataFrame, radius: int = 2, size_factor: float = 2, p: float = 0.9, slack: float = 1.1) -> Learnt:
    """What a run needs; refuses a graph whose dictionary is beyond MAX_PAIRS, as every task holds it."""
    pairs, keys = P.compatibility(nodes, arcs, radius)
    if pairs.limit(MAX_PAIRS + 1).count() > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} compatible pairs")
    found = P.extract_patterns(nodes, arcs, radius).drop("canonical").orderBy("pattern_id").collect()
    compat: dict[int, dict[int, set[int]]] = {r: {} for r in range(1, radius + 1)}
    for k in keys.collect():
        compat[k.radius][k.a] = set()
    for k in pairs.collect():
        compat[k.radius][k.a].add(k.b)
    cap = G.expansion_cap(nodes, arcs, p, slack).first().cap
    label, freq, degree = ({r.pattern_id: r[c] for r in found} for c in ("center_label", "frequency", "center_degree"))
    return Learnt(label, freq, degree, compat, int(nodes.count() * size_factor), cap)


def generate(spark: SparkSession, learnt: Learnt, seeds: list[int]) -> DataFrame:
    """(seed, id, label, larger) of one graph per seed; `larger` are the neighbours of larger id."""
    shared = spark.sparkContext.broadcast(learnt)

    def run(key, rows):
        return Run(shared.value, int(key[0])).grow().rows()

    frame = spark.createDataFrame([(int(s),) for s in seeds], "seed long")
    return frame.groupBy("seed").applyInPandas(run, "seed long, id long, label int, larger array<long>")


def generated_edges(graphs: DataFrame) -> DataFrame:
    """(seed, src, dst), src < dst, of what generate gives."""
    return graphs.select("seed", F.col("id").alias("src"), F.explode("larger").alias("dst"))


def generate_folder(spark: SparkSession, training: str, output: str, resume: str, seed: int = 42, radius: int = 2) -> list[int]:
    """One generated graph per training graph of the folder, from the resume index to the last; returns
    their numbers. The edges go by (src, dst), the labels by id, as lines. The resume file holds the
    next number after each graph and goes at the end; an error leaves it."""
    start = folders.resume_index(spark, resume)
    done = []
    for index in range(start, folders.last_index(spark, training, start) + 1):
        nodes, edges = folders.graph_of(spark, training, index)
        graph = generate(spark, learn(nodes, P.ordered_arcs(edges), radius), [seed])
        rows = graph.orderBy("id").collect()
        folders.write_lines(spark, f"{output}/graphedges{index}", [f"{r.id} {v}" for r in rows for v in r.larger])
        folders.write_lines(spark, f"{output}/graphlabels{index}", [f"{r.id} {r.label}" for r in rows])
        folders.save_index(spark, resume, index + 1)
        done.append(index)
    folders.forget_index(spark, resume)
    return done
