"""Operators over the state of a growing graph.

cells(run, cell, pos, pattern, domain): pattern is null for a cell that is not settled, domain the
array of patterns it may still take. near(src, dst) holds both directions. A dictionary is
patterns(id, label, frequency, degree), keys(radius, a) and compat(radius, a, b): a pattern may have
a key without partners, which excludes everything, or no key at that radius.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import base_slots, entropy, prune
from . import graph as G
from .numbering import numbered, numbered_within


def settled(cells: DataFrame) -> DataFrame:
    return cells.where("pattern is not null")


def open_cells(cells: DataFrame) -> DataFrame:
    return cells.where("pattern is null")


def allowed_sets(keys: DataFrame, compat: DataFrame) -> DataFrame:
    """(radius, a, allowed): the partners of every key, none as an empty array."""
    sets = compat.groupBy("radius", "a").agg(F.collect_set("b").alias("allowed"))
    return keys.join(sets, ["radius", "a"], "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<int>")))


def pruned(cells: DataFrame, near: DataFrame, keys: DataFrame, compat: DataFrame, radius: int) -> DataFrame:
    """(run, cell, pos, domain) of the open cells: what all settled cells up to `radius` away allow.

    Distances go through all cells. A settled pattern without a key at that distance forbids nothing.
    Equal constraints of a cell are one before their sets are joined.
    """
    seeds = settled(cells).select(F.col("cell").alias("id"), "pattern")
    reach = G.ego(seeds, near, radius).where("depth > 0").join(seeds.withColumnRenamed("id", "center"), "center")
    rules = reach.select(F.col("node").alias("cell"), F.col("depth").alias("radius"), F.col("pattern").alias("a")).distinct()
    sets = rules.join(allowed_sets(keys, compat), ["radius", "a"]).groupBy("cell").agg(F.collect_list("allowed").alias("sets"))
    left = F.aggregate(F.coalesce("sets", F.array().cast("array<array<int>>")), F.col("domain"), prune)
    return open_cells(cells).join(sets, "cell", "left").select("run", "cell", "pos", left.alias("domain"))


def forced(domains: DataFrame) -> DataFrame:
    """(run, cell, pattern) of the cells with one pattern left."""
    return domains.where("size(domain) = 1").select("run", "cell", F.col("domain")[0].alias("pattern"))


def _weighted(domains: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per cell and pattern of its domain, with the place in it and the frequency."""
    each = domains.select("run", "cell", "pos", F.posexplode("domain").alias("k", "id"))
    return each.join(patterns.select("id", "frequency"), "id")


def entropies(domains: DataFrame, patterns: DataFrame) -> DataFrame:
    """(run, cell, pos, entropy) of every cell; the terms are added in the order of the domain."""
    ordered = _weighted(domains, patterns).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "frequency"))).alias("w"))
    h = entropy(F.transform(F.coalesce("w", F.array().cast("array<struct<k:int,frequency:int>>")), lambda x: x["frequency"]))
    return domains.join(ordered, "cell", "left").select("run", "cell", "pos", h.alias("entropy"))


def selected(domains: DataFrame, patterns: DataFrame) -> DataFrame:
    """(run, cell): of each run the cell of least positive entropy, the first on ties; none if there is no such cell."""
    h = entropies(domains, patterns).where("entropy > 0")
    return h.groupBy("run").agg(F.min_by("cell", F.struct(F.round("entropy", 12), "pos")).alias("cell"))


def picked(domains: DataFrame, patterns: DataFrame, draws: DataFrame) -> DataFrame:
    """(cell, pattern): the first pattern whose running weight reaches the cell's draw(cell, u) of the total."""
    inside = Window.partitionBy("cell").orderBy("k")
    each = _weighted(domains, patterns).withColumn("upto", F.sum("frequency").over(inside)).withColumn("total", F.sum("frequency").over(Window.partitionBy("cell")))
    return each.join(draws, "cell").where("u * total <= upto").groupBy("cell").agg(F.min_by("id", "k").alias("pattern"))


def allocated(centers: DataFrame, budgets: DataFrame) -> DataFrame:
    """(run, cell, slots) of centers(run, cell, pos, degree) under budgets(run, budget).

    The share by degree, at least 1 and at most half the degree (rounded up); what is left goes by
    largest remainder, one more each, to those below their most. The least of 1 can exceed the budget.
    """
    run = Window.partitionBy("run")
    rows = centers.join(budgets, "run").withColumn("demand", F.sum("degree").over(run)).where("demand > 0 and budget > 0")
    rows = rows.withColumn("share", F.col("budget") * F.col("degree") / F.col("demand"))
    rows = rows.withColumn("base", base_slots(F.col("degree"), F.col("demand"), F.col("budget"))).withColumn("most", F.floor((F.col("degree") + 1) / 2))
    rows = rows.withColumn("surplus", F.col("budget") - F.sum("base").over(run)).withColumn("eligible", F.col("base") < F.col("most"))
    place = F.row_number().over(Window.partitionBy("run", "eligible").orderBy(F.desc(F.round(F.col("share") - F.col("base"), 12)), "pos"))
    extra = (F.col("eligible") & (place <= F.col("surplus"))).cast("int")
    return rows.select("run", "cell", (F.col("base") + extra).cast("long").alias("slots"))


def children(slots: DataFrame) -> DataFrame:
    """(run, parent, number): one row per new cell of the allocation."""
    some = slots.where("slots > 0")
    return some.select("run", F.col("cell").alias("parent"), F.explode(F.sequence(F.lit(1).cast("long"), "slots")).alias("number"))


def possible(cells: DataFrame) -> DataFrame:
    """(cell, domain) of cells that are not settled; a settled one fails the job."""
    return cells.select("cell", F.when(F.col("pattern").isNotNull(), F.raise_error(F.lit("the cell is settled"))).otherwise(F.col("domain")).alias("domain"))


def collapsed(cells: DataFrame, choices: DataFrame, patterns: DataFrame) -> DataFrame:
    """cells(run, cell, pos, pattern, label, domain) with choices(cell, pattern) settled: the pattern, its label
    and a domain of that pattern alone. A chosen cell that is settled, or cannot take the pattern, fails the job."""
    labels = patterns.select(F.col("id").alias("chosen"), F.col("label").alias("its_label"))
    asked = choices.select("cell", F.col("pattern").alias("chosen")).join(labels, "chosen", "left")
    chosen = F.col("chosen")
    fault = F.when(F.col("pattern").isNotNull(), F.lit("the cell is settled")).when(~F.coalesce(F.array_contains("domain", chosen), F.lit(False)), F.lit("the pattern is not possible"))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(chosen)
    rows = cells.join(asked, "cell", "left").withColumn("now", F.when(chosen.isNotNull(), checked))
    return rows.select(
        "run", "cell", "pos", F.coalesce("now", "pattern").alias("pattern"), F.when(F.col("now").isNotNull(), F.col("its_label")).otherwise(F.col("label")).alias("label"),
        F.when(F.col("now").isNotNull(), F.array("now")).otherwise(F.col("domain")).alias("domain"),
    )


def born(cells: DataFrame, slots: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new cells(run, cell, pos, parent, domain) of slots(run, cell, slots), and their arcs(src, dst) in both
    directions. Parents follow their place, numbers go on from the largest cell and from the run's largest
    place, and every pattern is possible."""
    parents = cells.select("run", F.col("cell").alias("parent"), F.col("pos").alias("parent_pos"))
    new = numbered_within(children(slots).join(parents, ["run", "parent"]), "run", ["parent_pos", "number"], "nth")
    new = numbered(new, ["run", "nth"], "at")
    last = cells.groupBy("run").agg(F.max("pos").alias("last_pos"))
    largest = cells.agg(F.coalesce(F.max("cell"), F.lit(0)).alias("largest"))
    full = patterns.agg(F.array_sort(F.collect_set("id")).alias("domain"))
    # Both are one row.
    rows = new.join(last, "run").crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(full))
    rows = rows.select("run", (F.col("largest") + 1 + F.col("at")).alias("cell"), (F.col("last_pos") + 1 + F.col("nth")).alias("pos"), "parent", "domain")
    return rows, G.arcs_of(rows.select(F.col("parent").alias("src"), F.col("cell").alias("dst")))


def stubs(cells: DataFrame, near: DataFrame, targets: DataFrame) -> DataFrame:
    """(run, cell, pattern, stubs) of the settled cells that have fewer neighbours than their target(cell, target)."""
    degree = near.groupBy(F.col("src").alias("cell")).agg(F.count("*").alias("degree"))
    missing = F.coalesce("target", F.lit(0)) - F.coalesce("degree", F.lit(0))
    rows = settled(cells).join(targets, "cell", "left").join(degree, "cell", "left").withColumn("stubs", missing.cast("long"))
    return rows.where("stubs > 0").select("run", "cell", "pattern", "stubs")


def open_stubs(open_ends: DataFrame) -> DataFrame:
    return open_ends.groupBy("run").agg(F.sum("stubs").alias("open_stubs"))


def candidates(open_ends: DataFrame, near: DataFrame, compat: DataFrame) -> DataFrame:
    """(run, u, v, pu, pv), u < v: cells with stubs that are not neighbours and go together at radius 1."""
    one = compat.where("radius = 1").select(F.col("a").alias("pu"), F.col("b").alias("pv"))
    u = open_ends.select("run", F.col("cell").alias("u"), F.col("pattern").alias("pu"))
    v = open_ends.select("run", F.col("cell").alias("v"), F.col("pattern").alias("pv"))
    pairs = u.join(one, "pu").join(v, ["run", "pv"]).where("u < v")
    return pairs.join(near.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti").select("run", "u", "v", "pu", "pv")


def valid_pairs(pairs: DataFrame, cells: DataFrame, near: DataFrame, compat: DataFrame, radius: int) -> DataFrame:
    """The pairs where every settled cell k steps from one end goes with the other end's pattern at radius
    k + 1, for k < radius; only settled cells are entered."""
    known = settled(cells).select(F.col("cell").alias("id"), "pattern")
    inner = near.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    both = pairs.select("run", "u", "v", F.col("u").alias("end"), F.col("pv").alias("other")).union(pairs.select("run", "u", "v", F.col("v").alias("end"), F.col("pu").alias("other")))
    ends = both.select(F.col("end").alias("id")).distinct()
    rings = G.ego(ends, inner, radius - 1).where("depth > 0").join(known.select(F.col("id").alias("node"), F.col("pattern").alias("a")), "node")
    rules = both.join(rings, F.col("end") == F.col("center")).select("u", "v", (F.col("depth") + 1).alias("radius"), "a", F.col("other").alias("b")).distinct()
    broken = rules.join(compat, ["radius", "a", "b"], "left_anti").select("u", "v").distinct()
    return pairs.join(broken, ["u", "v"], "left_anti").select("run", "u", "v", "pu", "pv")


def pattern_scores(compat: DataFrame) -> DataFrame:
    """(a, b, score), a < b: the sum over common partners at radius 1 of 1 / how many partners these have."""
    one = compat.where("radius = 1").select("a", "b")
    degree = one.groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "m")
    left, right = one.select("a", F.col("b").alias("m")), one.select(F.col("a").alias("b"), F.col("b").alias("m"))
    return left.join(right, "m").where("a < b").join(degree, "m").groupBy("a", "b").agg(F.round(F.sum(1 / F.col("degree")), 9).alias("score"))


def scored(pairs: DataFrame, compat: DataFrame) -> DataFrame:
    """The pairs with the score of their patterns, 0 without common partners.

    Only patterns that meet in a pair are scored, each pair once: the partners of one are looked up
    among those of the other.
    """
    least, most = F.least("pu", "pv"), F.greatest("pu", "pv")
    one = compat.where("radius = 1").select("a", F.col("b").alias("m"))
    degree = one.groupBy(F.col("a").alias("m")).agg(F.count("*").alias("degree"))
    met = pairs.select(least.alias("a"), most.alias("b")).distinct()
    common = met.join(one, "a").join(one.withColumnRenamed("a", "b"), ["b", "m"])
    s = common.join(degree, "m").groupBy("a", "b").agg(F.round(F.sum(1 / F.col("degree")), 9).alias("score"))
    joined = pairs.join(s, (least == s["a"]) & (most == s["b"]), "left")
    return joined.select("run", "u", "v", "pu", "pv", F.coalesce("score", F.lit(0.0)).alias("score"))


def exported(cells: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, id, label) and (run, src, dst), src < dst: settled cells by number in settled order from 0,
    neighbours that are not settled, loops and repeats left out. cells has `label` too."""
    known = numbered_within(settled(cells).select("run", "cell", "label", "pos"), "run", ["pos"], "id").select("run", "cell", "label", F.col("id").cast("int").alias("id"))
    ids = known.select(F.col("cell").alias("c"), F.col("id").alias("i"))
    edges = near.join(known.select("run", F.col("cell").alias("src"), F.col("id").alias("a")), "src").join(ids, F.col("dst") == F.col("c"))
    edges = edges.where("a < i").select("run", F.col("a").alias("src"), F.col("i").alias("dst")).distinct()
    labels = known.select("run", "id", F.when(F.col("label").isNull(), F.raise_error(F.lit("a settled cell has no label"))).otherwise(F.col("label")).alias("label"))
    return labels, edges


def wave_budget(forced_cells, cap: int, frontier):
    """Cells that a wave may add: ceil(sqrt(forced)) * cap - frontier, none below 0."""
    return F.greatest(F.lit(0), F.ceil(F.sqrt(forced_cells)) * cap - frontier)
