"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_columns, table

#: Vectors that the trees' planes are taken from, the least by hash of vec_id.
FIT_ROWS = 20_000
TREES = 16
LEAF_ROWS = 64
#: Queries that the number of visited leaves is measured on, the least by hash of query_id, and
#: the share of their true neighbours that it must reach: some above the 0.9 asked of all queries.
SAMPLE = 100
RECALL = 0.94
#: Visits of one block of queries, which every task holds.
BLOCK_VISITS = 1 << 22
#: Vectors that a task looks up by leaf at a time, and pairs that it measures at a time, one query's as a whole.
BATCH_ROWS = 8_192
BLOCK_PAIRS = 1 << 20


class Forest:
    """Planes per tree as flat arrays; a child below zero is the leaf ~child."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees, self.first = [], [0]
        for _ in range(trees):
            planes, cuts, children, leaves = [], [], [], 0

            def grow(rows, level):
                nonlocal leaves
                if level == 0 or len(rows) < 2:
                    leaves += 1
                    return ~(leaves - 1)
                a, b = sample[rng.choice(rows, 2, replace=False)]
                plane = a - b
                if not plane.any():
                    plane = rng.normal(size=sample.shape[1])
                plane = plane / np.linalg.norm(plane)
                at = len(planes)
                side = sample[rows] @ plane
                middle = float(np.median(side))
                planes.append(plane)
                cuts.append(middle)
                children.append([0, 0])
                left = side <= middle
                if left.all():
                    left = side < middle
                children[at][0] = grow(rows[left], level - 1)
                children[at][1] = grow(rows[~left], level - 1)
                return at

            root = grow(np.arange(len(sample)), depth)
            #: Leaves are numbered through all trees.
            self.first.append(self.first[-1] + leaves)
            self.trees.append((root, np.array(planes).reshape(-1, sample.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2)))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in every tree; a row only meets the planes on its way."""
        out = np.empty((len(x), len(self.trees)), np.int64)
        for k, (first, (root, planes, cuts, children)) in enumerate(zip(self.first, self.trees)):
            at = np.full(len(x), root)
            while (rows := np.flatnonzero(at >= 0)).size:
                here = at[rows]
                side = np.einsum("ij,ij->i", planes[here], x[rows]) > cuts[here]
                at[rows] = children[here, side.astype(int)]
            out[:, k] = first + ~at
        return out

    def search(self, x: np.ndarray, visits: int) -> list[int]:
        """Leaves by growing distance to the planes crossed, all trees in one queue."""
        queue = [(0.0, k, t[0]) for k, t in enumerate(self.trees)]
        out = []
        while queue and len(out) < visits:
            far, k, at = heapq.heappop(queue)
            while at >= 0:
                _, planes, cuts, children = self.trees[k]
                side = float(planes[at] @ x - cuts[at])
                near = int(side > 0)
                heapq.heappush(queue, (max(far, abs(side)), k, int(children[at, 1 - near])))
                at = int(children[at, near])
            out.append(self.first[k] + ~at)
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id whose vector is neither null, empty nor zero and holds finite numbers only."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.where("vec_id is not null").where(F.coalesce(fine, F.lit(False))).select("vec_id", "embedding").dropDuplicates(["vec_id"])


class Best:
    """The k nearest groups of each query so far, as flat arrays sorted by (query, score, gid)."""

    def __init__(self, queries: int, k: int, trees: int):
        self.k, self.limit = k, np.full(queries, np.inf)
        self.query, self.score, self.gid = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.leaves = np.empty((0, trees), np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, gid: np.ndarray, leaves: np.ndarray) -> None:
        near = score <= self.limit[query]
        query, score = np.concatenate([self.query, query[near]]), np.concatenate([self.score, score[near]])
        gid, leaves = np.concatenate([self.gid, gid[near]]), np.concatenate([self.leaves, leaves[near]])
        order = np.lexsort((gid, score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < self.k]
        self.query, self.score, self.gid, self.leaves = query[order], score[order], gid[order], leaves[order]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.limit[self.query[full]] = self.score[full]


def visited_pairs(asked: np.ndarray, wanted: np.ndarray, leaves: np.ndarray):
    """Arrays of (query, row), each pair once and at most about BLOCK_PAIRS at a time, where the row lies in a leaf
    that the query visits. asked holds ascending queries, wanted the leaf of each visit, leaves the rows' leaves."""
    order = np.argsort(leaves, axis=None, kind="stable")
    held = leaves.ravel()[order]
    lo = np.searchsorted(held, wanted)
    size = np.searchsorted(held, wanted, "right") - lo
    upto = np.cumsum(size)
    # A block ends with a query, so that pairs met through several trees meet in it.
    ends = np.flatnonzero(np.append(asked[1:] != asked[:-1], True)) + 1 if len(asked) else np.empty(0, int)
    at = 0
    while at < len(asked):
        start = upto[at - 1] if at else 0
        fit = ends[(ends > at) & (upto[ends - 1] - start <= BLOCK_PAIRS)]
        end = int(fit[-1] if len(fit) else ends[ends > at][0])
        n = size[at:end]
        first = np.repeat(lo[at:end] - (np.cumsum(n) - n), n)
        row = order[first + np.arange(n.sum())] // leaves.shape[1]
        pair = np.unique(np.repeat(asked[at:end], n) * len(leaves) + row)
        yield pair // len(leaves), pair % len(leaves)
        at = end


def nearest(groups: DataFrame, asked: list, k: int, counted=None) -> DataFrame:
    """query_id, gid, score, leaves: of each partition the k nearest groups of every asked query
    among those in its visited leaves (visits None: among all), ties to the smaller gid.

    The groups stay where they are; only the block of queries travels. A partition looks its rows up by
    leaf, so that only visited rows are measured; the accumulator `counted` takes their number.
    """
    q = np.array([r.q for r in asked])
    every = asked[0].visits is None
    visits = None if every else [np.array(r.visits, np.int64) for r in asked]
    at = None if every else np.repeat(np.arange(len(asked)), [len(v) for v in visits])
    block = groups.sparkSession.sparkContext.broadcast(([r.query_id for r in asked], q, at, None if every else np.concatenate(visits)))

    def part(batches):
        import pyarrow as pa

        ids, q, at, wanted = block.value
        best = None
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(lo, BATCH_ROWS)
                gid = some.column(0).to_numpy()
                x = np.array(some.column(1).to_pylist())
                leaves = np.array(some.column(2).to_pylist(), np.int64)
                best = best or Best(len(q), k, leaves.shape[1])
                if wanted is None:
                    pairs = ((np.full(len(x), i), np.arange(len(x))) for i in range(len(q)))
                else:
                    pairs = visited_pairs(at, wanted, leaves)
                for query, row in pairs:
                    if counted is not None:
                        counted.add(len(query))
                    gap = np.empty(len(query))
                    for c in range(0, len(query), 1 << 14):
                        part = slice(c, c + (1 << 14))
                        # A running sum adds in the order of the components.
                        gap[part] = np.cumsum((q[query[part]] - x[row[part]]) ** 2, axis=1)[:, -1]
                    best.add(query, np.sqrt(gap), gid[row], leaves[row])
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[best.query], pa.int64()), pa.array(best.gid, pa.int64()), pa.array(best.score, pa.float64()), pa.array(best.leaves.tolist(), pa.list_(pa.int64()))], names=["query_id", "gid", "score", "leaves"])

    out = groups.mapInArrow(part, "query_id long, gid long, score double, leaves array<long>")
    return out.withColumn("o", F.row_number().over(Window_by("query_id", "score", "gid"))).where(F.col("o") <= k).drop("o")


def visits_needed(groups: DataFrame, asked: DataFrame, forest, k: int, recall: float = RECALL) -> int:
    """The least number of visited leaves that finds the share `recall` of the true nearest groups
    of SAMPLE queries, which brute force over all groups gives."""
    some = asked.withColumn("visits", F.lit(None).cast("array<int>")).orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).collect()
    if not some:
        return 1
    truth: dict[int, list] = {}
    for r in nearest(groups, some, k).collect():
        truth.setdefault(r.query_id, []).append(r.leaves)
    every = forest.value.first[-1]
    needed = []
    for r in some:
        at = {leaf: n for n, leaf in enumerate(forest.value.search(np.array(r.q), every), 1)}
        needed += [min(at[leaf] for leaf in leaves) for leaves in truth[r.query_id]]
    return sorted(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, visits: int | None = None, counted=None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, ties to the smaller vec_id.

    The leaves that a query visits follow from a recall measured on this table, unless given.
    Equal vectors are indexed once, by their group, so that copies don't fill the leaves; a group
    gives a query its k + 1 smallest ids, more cannot be among the k nearest. Only vectors of one
    length have a distance, so each length is an index of its own. Null, empty and zero vectors,
    those with null or non-finite components and rows without an id take no part; of rows with one
    id one is taken; an empty table gives an empty result; other columns are not read. The accumulator
    `counted` takes the number of distances measured for the result.
    """
    good = cut(usable(vectors).withColumn("embedding", F.col("embedding").cast("array<double>")))
    asked = queries.select("vec_id").distinct()
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in good.join(asked, "vec_id", "left_semi").select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():
        out = out.union(_search(good.where(F.size("embedding") == r["d"]), asked, k, visits, counted))
    return out


def _search(good: DataFrame, queries: DataFrame, k: int, visits: int | None, counted) -> DataFrame:
    """search among usable vectors of one length."""
    vectors, schema = good, "query_id long, rank int, vec_id long, score double"
    groups = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("gid")))
    fit = np.array([r.embedding for r in groups.orderBy(F.xxhash64("gid")).limit(FIT_ROWS).collect()])
    depth = max(0, int(np.ceil(np.log2(max(1, groups.count() / LEAF_ROWS)))))
    depth = min(depth, int(np.log2(max(2, len(fit)))))
    forest = vectors.sparkSession.sparkContext.broadcast(Forest(fit, depth))

    def place(ids, found):
        return ids, found, forest.value.leaves(np.array(found, float)).tolist()

    placed = cut(map_columns(groups, ["gid", "embedding"], place, "gid long, embedding array<double>, leaves array<long>"))
    asked = cut(queries.select("vec_id").join(good, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    # A query's own group may hold nothing but the query: one group more than k is kept.
    visits = visits or visits_needed(placed, asked, forest, k + 1)

    def look(ids, found):
        return ids, found, [forest.value.search(np.array(v), visits) for v in found]

    asked = cut(map_columns(asked, ["query_id", "q"], look, "query_id long, q array<double>, visits array<int>"))
    blocks = max(1, -(-asked.count() // min(4096, max(64, BLOCK_VISITS // visits))))
    best = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if some:
            found = cut(nearest(placed, some, k + 1, counted).select("query_id", "gid", "score"))
            best = found if best is None else best.union(found)
    if best is None:
        return vectors.sparkSession.createDataFrame([], schema)
    ids = good.join(groups, "embedding").select("gid", "vec_id")
    ids = ids.withColumn("o", F.row_number().over(Window_by("gid", "vec_id"))).where(F.col("o") <= k + 1).select("gid", "vec_id")
    full = best.join(ids, "gid").where("vec_id <> query_id")
    full = full.withColumn("rank", F.row_number().over(Window_by("query_id", "score", "vec_id"))).where(F.col("rank") <= k)
    return full.select("query_id", "rank", "vec_id", "score")


def Window_by(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth embedding among all others."""
    v = table(spark, sf_dir, "embeddings")
    return search(v, v.where("vec_id % 100 = 0").select("vec_id").distinct())
