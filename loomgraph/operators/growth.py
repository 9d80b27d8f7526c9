"""Growing many graphs at once: every step is a set operation over the cells of all runs.

A round lets each run that has not ended take its next step: settle one cell by a weighted draw, wire,
add cells, or prune one wave around the cells settled last. Runs may stand at different steps; one that
has ended leaves the rounds. No task holds a graph and none of it reaches the driver but how many runs
stand where.

runs(run, seed, target, phase, step, then, allowance, draws), cells(run, cell, placed, pattern, target,
domain, fresh), near(src, dst) in both directions, sets(domain, word, bits) as in `bits`. A cell is its
run's number in the upper 32 bits and its own, by age, in the lower; placed orders settled cells and is
null for open ones; fresh cells are those the next wave prunes around.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bits as B
from . import cells as C
from . import graph as G
from . import matching as M
from .lineage import gathered


@dataclass
class State:
    cells: DataFrame
    near: DataFrame
    sets: DataFrame

    def open(self) -> DataFrame:
        return self.cells.where("placed is null")

    def done(self) -> DataFrame:
        return self.cells.where("placed is not null")


def draw(seed: Column, k: Column) -> Column:
    """The k-th draw of a run in [0, 1), the same on every machine."""
    return F.crc32(F.concat_ws(":", seed.cast("string"), k.cast("string"))) / F.lit(2.0**32)


def started(runs: DataFrame, d: B.Dictionary) -> State:
    """One open cell per run that may take every pattern."""
    spark = runs.sparkSession
    name, sets = B.full_set(d)
    cells = runs.select("run", F.shiftleft("run", 32).alias("cell"), F.lit(None).cast("long").alias("placed"), F.lit(None).cast("long").alias("pattern"), F.lit(0).cast("long").alias("target"), F.lit(name).alias("domain"), F.lit(False).alias("fresh"))
    return State(gathered(cells), spark.createDataFrame([], "src long, dst long"), gathered(sets))


def _with_children(s: State, slots: DataFrame, full: str) -> State:
    """The state with new open cells: slots(run, cell, pos, slots) of them below each cell, in order of pos."""
    slots = slots.where("slots > 0")
    size = s.cells.groupBy("run").agg(F.count("*").alias("size"))
    before = F.sum("slots").over(Window.partitionBy("run").orderBy("pos")) - F.col("slots")
    each = slots.withColumn("before", before).join(size, "run")
    number = F.col("size") + F.col("before") + F.col("k") - 1
    new = gathered(each.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("slots").cast("long")))).select("run", F.col("cell").alias("parent"), (F.shiftleft("run", 32) + number).alias("cell")))
    if new.isEmpty():
        return s
    cells = new.select("run", "cell", F.lit(None).cast("long").alias("placed"), F.lit(None).cast("long").alias("pattern"), F.lit(0).cast("long").alias("target"), F.lit(full).alias("domain"), F.lit(False).alias("fresh"))
    near = new.select(F.col("parent").alias("src"), F.col("cell").alias("dst")).union(new.select("cell", "parent"))
    return replace(s, cells=gathered(s.cells.union(cells)), near=gathered(s.near.union(near)))


def expanded(s: State, centers: DataFrame, budgets: DataFrame, d: B.Dictionary, full: str) -> State:
    """Children for centers(run, cell, pattern) under budgets(run, budget), by the degrees of their patterns."""
    degree = centers.join(d.patterns.select(F.col("id").alias("pattern"), "degree"), "pattern").select("run", "cell", F.col("cell").alias("pos"), "degree")
    slots = C.allocated(degree, budgets).withColumn("pos", F.col("cell"))
    return _with_children(s, slots, full)


def wave(s: State, waving: DataFrame, d: B.Dictionary, full: str, turn: int) -> tuple[State, DataFrame]:
    """One wave for the runs waving(run, allowance), and (run, forced): how many cells it settled.

    The open cells near fresh ones are pruned by them; cells with one pattern left settle without a target,
    are the only fresh ones afterwards, and get children within ceil(sqrt(forced)) * allowance less the
    open cells.
    """
    runs = waving.select("run", "allowance")
    open_ = s.open().join(runs, "run", "left_semi").select("run", "cell", "domain")
    seeds = s.done().where("fresh").join(runs, "run", "left_semi").select(F.col("cell").alias("node"), F.col("pattern").alias("a"))
    reach = G.ego(open_.select(F.col("cell").alias("id")), s.near, d.radius).where("depth > 0")
    rules = reach.join(seeds, "node").select(F.col("center").alias("cell"), F.col("depth").alias("radius"), "a")
    changed, new = B.pruned_sets(open_.select("cell", "domain"), s.sets, rules, d)
    now = gathered(open_.join(changed.withColumnRenamed("domain", "new"), "cell", "left").select("run", "cell", F.coalesce("new", "domain").alias("new")))
    used = now.select(F.col("new").alias("domain")).union(s.open().join(runs, "run", "left_anti").select("domain")).union(s.cells.sparkSession.range(1).select(F.lit(full).alias("domain"))).distinct()
    sets = s.sets.union(new.join(s.sets.select("domain").distinct(), "domain", "left_anti")).join(used, "domain", "left_semi")
    sets = gathered(sets)
    one = B.singles(sets.join(now.select(F.col("new").alias("domain")).distinct(), "domain", "left_semi"), d)
    forced = gathered(now.join(one.withColumnRenamed("domain", "new"), "new").select("run", "cell", F.col("pattern").alias("forced")))
    cells = s.cells.join(now.select("cell", "new"), "cell", "left").join(forced.drop("run"), "cell", "left").join(runs.select("run", F.lit(True).alias("waves")), "run", "left")
    is_forced = F.col("forced").isNotNull()
    cells = gathered(cells.select("run", "cell", F.when(is_forced, _place(turn, 1)).otherwise(F.col("placed")).alias("placed"), F.coalesce("forced", "pattern").alias("pattern"), "target", F.coalesce("new", "domain").alias("domain"), F.when(F.col("waves"), is_forced).otherwise(F.col("fresh")).alias("fresh")))
    counts = forced.groupBy("run").agg(F.count("*").alias("forced"))
    left = now.groupBy("run").agg(F.count("*").alias("open"))
    budgets = counts.join(runs, "run").join(left, "run").select("run", C.wave_budget(F.col("forced"), F.col("allowance"), F.col("open") - F.col("forced")).alias("budget"))
    s = State(cells, s.near, sets)
    if not forced.isEmpty():
        s = expanded(s, forced.withColumnRenamed("forced", "pattern"), budgets, d, full)
    return s, counts


def _place(turn: int, kind: int) -> Column:
    return F.lit((2 * turn + kind) << 32) + F.col("cell").bitwiseAND(F.lit((1 << 32) - 1))


def propagated(s: State, waving: DataFrame, d: B.Dictionary, turn: int = 0) -> tuple[State, int]:
    """Waves for the runs waving(run, allowance) until none forces a cell, and how many there were."""
    full, _ = B.full_set(d)
    n = 0
    waving = gathered(waving.select("run", "allowance"))
    while not waving.isEmpty():
        s, counts = wave(s, waving, d, full, turn + n)
        n += 1
        waving = gathered(waving.join(counts, "run", "left_semi"))
    return s, n


def collapsed(s: State, choosing: DataFrame, d: B.Dictionary, turn: int) -> tuple[State, DataFrame]:
    """Settles for each run of choosing(run, seed, draws) the first open cell of least positive entropy by a
    weighted draw among its patterns in order of id; (run, cell, pattern) of those settled."""
    open_ = s.open().join(choosing, "run", "left_semi").select("run", "cell", "domain")
    sets = s.sets.join(open_.select("domain").distinct(), "domain", "left_semi")
    h = B.set_entropies(sets, d).where("entropy > 0")
    least = open_.join(h, "domain").groupBy("run").agg(F.min_by(F.struct("cell", "domain", "total"), F.struct("entropy", "cell")).alias("least")).select("run", "least.*")
    least = least.join(choosing, "run").select("run", "cell", "domain", (draw(F.col("seed"), F.col("draws")) * F.col("total")).alias("reach"))
    sums = B.members(sets.join(least.select("domain").distinct(), "domain", "left_semi"), d).withColumn("upto", F.sum("frequency").over(Window.partitionBy("domain").orderBy("id")))
    found = sums.join(least, "domain").where("upto >= reach").groupBy("run", "cell").agg(F.min("id").alias("chosen"))
    found = gathered(found.join(d.patterns.select(F.col("id").alias("chosen"), "degree"), "chosen"))
    chosen = F.col("chosen").isNotNull()
    cells = s.cells.join(found.select("cell", "chosen", "degree"), "cell", "left").join(found.select("run", F.lit(True).alias("ran")), "run", "left")
    cells = cells.select("run", "cell", F.when(chosen, _place(turn, 0)).otherwise(F.col("placed")).alias("placed"), F.coalesce("chosen", "pattern").alias("pattern"), F.when(chosen, F.col("degree")).otherwise(F.col("target")).cast("long").alias("target"), "domain", F.when(F.col("ran"), chosen).otherwise(F.col("fresh")).alias("fresh"))
    return replace(s, cells=gathered(cells)), found.select("run", "cell", F.col("chosen").alias("pattern"))


def missing(s: State, runs: DataFrame) -> DataFrame:
    """(run, cell, pattern, stubs, placed) of the settled cells with fewer neighbours than their target."""
    rows = s.done().where("target > 0").join(runs, "run", "left_semi")
    degree = s.near.join(rows.select(F.col("cell").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("cell")).agg(F.count("*").alias("degree"))
    return rows.join(degree, "cell", "left").withColumn("stubs", F.col("target") - F.coalesce("degree", F.lit(0))).where("stubs > 0").select("run", "cell", "pattern", "stubs", "placed")


def connected(s: State, joining: DataFrame, d: B.Dictionary) -> tuple[State, DataFrame]:
    """Wires settled cells that lack neighbours in the runs of joining(run); (run, made) edges.

    Pairs meet through the paths their patterns share, are tested by the rules before the round only and
    taken by score, ties by cell.
    """
    spark = s.cells.sparkSession
    nothing = spark.createDataFrame([], "run long, made long")
    ends = missing(s, joining)
    u = ends.select("run", F.col("cell").alias("u"), F.col("pattern").alias("a")).join(d.out, "a")
    v = ends.select("run", F.col("cell").alias("v"), F.col("pattern").alias("b")).join(d.into, "b")
    pairs = u.join(v, ["run", "path"]).where("u < v and a <> b").select("run", "u", "v", F.col("a").alias("pu"), F.col("b").alias("pv")).distinct()
    pairs = gathered(pairs.join(s.near.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti"))
    if pairs.isEmpty():
        return s, nothing
    ends = gathered(ends)
    known = s.done().select(F.col("cell").alias("id"), "pattern")
    both = pairs.select("u", "v", F.col("u").alias("end"), F.col("pv").alias("b")).union(pairs.select("u", "v", F.col("v").alias("end"), F.col("pu").alias("b")))
    if d.radius > 1:
        inner = s.near.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
        rings = G.ego(both.select(F.col("end").alias("id")).distinct(), inner, d.radius - 1).where("depth > 0").join(known.select(F.col("id").alias("node"), F.col("pattern").alias("a")), "node")
        rules = gathered(both.join(rings, F.col("end") == F.col("center")).select("u", "v", (F.col("depth") + 1).alias("radius"), "a", "b").distinct())
        kept = B.allowed_pairs(rules.select("radius", "a", "b").distinct(), d)
        pairs = pairs.join(rules.join(kept, ["radius", "a", "b"], "left_anti").select("u", "v").distinct(), ["u", "v"], "left_anti")
    least, most = F.least("pu", "pv").alias("a"), F.greatest("pu", "pv").alias("b")
    pairs = gathered(pairs.select("run", "u", "v", least, most))
    scored = pairs.join(B.partner_scores(pairs, d), ["a", "b"], "left").select("run", "u", "v", F.coalesce("score", F.lit(0.0)).alias("score"))
    taken = gathered(M.greedy(scored, ends.select("cell", "stubs")))
    if taken.isEmpty():
        return s, nothing
    near = s.near.union(taken.select("u", "v")).union(taken.select("v", "u"))
    return replace(s, near=gathered(near)), gathered(taken.groupBy("run").agg(F.count("*").alias("made")))


RUN = ["run", "seed", "target", "phase", "step", "then", "allowance", "draws"]


def grow(runs: DataFrame, d: B.Dictionary, cap: int) -> State:
    """The graphs of runs(run, seed, target): grown to 0.9 of the target, cleaned up and completed.

    run is a number below 2**31 of its own. Every draw follows from the seed and how many came before.
    """
    full, _ = B.full_set(d)
    s = started(runs, d)
    rows = runs.select(F.col("run").cast("long").alias("run"), F.col("seed").cast("long").alias("seed"), F.col("target").cast("long").alias("target"), F.lit("grow").alias("phase"), F.lit("choose").alias("step"), F.lit("choose").alias("then"), F.lit(cap).cast("long").alias("allowance"), F.lit(0).cast("long").alias("draws"))
    rows, turn = gathered(rows), 0
    while not (live := rows.where("phase <> 'done'")).isEmpty():
        s, rows = _round(s, rows, live, d, cap, full, turn)
        turn += 1
    return s


def _standing(s: State, rows: DataFrame, cap: int) -> DataFrame:
    """The runs before a round, with what each does in it: settle (picks), wire (wires), add cells (adds)."""
    sizes = s.cells.groupBy("run").agg(F.count("placed").alias("done"), F.count_if(F.col("placed").isNull()).alias("open"))
    stubs = missing(s, rows.where("phase = 'clean'")).groupBy("run").agg(F.sum("stubs").alias("stubs"))
    rows = rows.join(sizes, "run", "left").join(stubs, "run", "left").na.fill(0, ["stubs", "done", "open"])
    share = F.col("done") / F.col("target")
    choosing = F.col("step") == "choose"
    rows = rows.withColumn("phase", F.when((F.col("phase") == "grow") & choosing & (share >= 0.9), F.lit("turn")).otherwise(F.col("phase")))
    cleaning = (F.col("phase") == "clean") & choosing
    decay = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(1.1) - share) / F.lit(0.1)))
    allowance = F.least(F.ceil(decay * cap), F.greatest(F.lit(0), F.col("stubs") - F.col("open")))
    stop = cleaning & (((F.col("stubs") == 0) & (F.col("open") == 0)) | (F.col("done") >= F.ceil(F.col("target") * F.lit(1.1))))
    rows = rows.withColumns({"stop": stop, "allowance": F.when(cleaning, allowance).when(F.col("phase") == "grow", F.lit(cap)).when(F.col("phase") == "last", F.lit(0)).otherwise(F.col("allowance")).cast("long")})
    rows = rows.withColumn("adds", cleaning & ~F.col("stop") & (F.col("open") == 0) & (F.col("stubs") > 0) & (F.col("allowance") > 0))
    pick = (F.col("phase").isin("grow", "last") & choosing) | (F.col("step") == "pick")
    join = (F.col("step") == "join") | (cleaning & ~F.col("stop") & ~F.col("adds"))
    return rows.withColumns({"picks": pick, "wires": join})


def _round(s: State, rows: DataFrame, live: DataFrame, d: B.Dictionary, cap: int, full: str, turn: int) -> tuple[State, DataFrame]:
    now = gathered(_standing(s, live, cap))
    acts = now.agg(*(F.max(c).alias(c) for c in ("picks", "wires", "adds")), F.max(F.col("picks") & (F.col("phase") != "grow")).alias("late")).first()
    picked = made = None
    if acts["picks"]:
        s, picked = collapsed(s, now.where("picks").select("run", "seed", "draws"), d, turn)
    spark = s.cells.sparkSession
    picked = spark.createDataFrame([], "run long, cell long, pattern long") if picked is None else picked
    now = now.join(picked.select("run", F.lit(True).alias("picked")), "run", "left").na.fill(False, ["picked"])
    # After a pick growth expands first and wires after its waves; the others wire at once, the last time without a pick.
    if acts["wires"] or acts["late"]:
        s, made = connected(s, now.where("wires or (picks and phase = 'clean' and picked) or (picks and phase = 'last')").select("run"), d)
    made = spark.createDataFrame([], "run long, made long") if made is None else made
    now = now.join(made, "run", "left").na.fill(0, ["made"])
    grown = now.where("picked and phase in ('grow', 'clean')")
    if acts["picks"]:
        budget = F.when(F.col("phase") == "grow", F.col("allowance") - (F.col("open") - 1)).otherwise(F.col("allowance"))
        s = expanded(s, picked.join(grown, "run", "left_semi"), grown.select("run", budget.alias("budget")), d, full)
    if acts["adds"]:
        lacking = missing(s, now.where("adds")).join(now.select("run", "allowance"), "run")
        before = F.sum("stubs").over(Window.partitionBy("run").orderBy("placed")) - F.col("stubs")
        slots = lacking.withColumn("slots", F.least(F.col("stubs"), F.greatest(F.lit(0), F.col("allowance") - before)).cast("long")).select("run", "cell", F.col("placed").alias("pos"), "slots")
        s = _with_children(s, slots, full)
    # Wiring is followed by waves around all settled cells, a pick by those around the cell picked.
    around_all = now.where("(phase = 'grow' and wires) or (phase = 'clean' and wires and made > 0)").select("run", F.lit(True).alias("every"))
    if acts["wires"]:
        cells = s.cells.join(around_all, "run", "left")
        s = replace(s, cells=gathered(cells.select("run", "cell", "placed", "pattern", "target", "domain", F.when(F.col("every"), F.col("placed").isNotNull()).otherwise(F.col("fresh")).alias("fresh"))))
    waving = now.where("step = 'wave' or picked or (phase = 'grow' and wires) or (phase = 'clean' and wires and made > 0)").select("run", "allowance")
    forced = spark.createDataFrame([], "run long, forced long")
    if not waving.isEmpty():
        s, forced = wave(s, waving, d, full, turn)
    now = now.join(waving.select("run", F.lit(True).alias("waved")), "run", "left").join(forced, "run", "left").na.fill(False, ["waved"]).na.fill(0, ["forced"])
    then = F.when(F.col("step") == "wave", F.col("then")).when((F.col("phase") == "grow") & F.col("picked"), F.lit("join")).otherwise(F.lit("choose"))
    phase = (
        F.when(F.col("phase") == "turn", "clean").when((F.col("phase") == "grow") & F.col("picks") & ~F.col("picked"), "clean")
        .when(F.col("stop") | ((F.col("phase") == "clean") & F.col("picks") & ~F.col("picked")), "last").when((F.col("phase") == "last") & F.col("picks") & ~F.col("picked"), "done").otherwise(F.col("phase"))
    )
    step = F.when(F.col("forced") > 0, "wave").when((F.col("phase") == "clean") & F.col("wires") & (F.col("made") == 0), "pick").when(F.col("waved"), then).otherwise("choose")
    draws = F.col("draws") + F.col("picked").cast("int")
    now = now.select("run", "seed", "target", phase.alias("phase"), step.alias("step"), then.alias("then"), "allowance", draws.cast("long").alias("draws"))
    return s, gathered(now)


def exported(s: State, d: B.Dictionary) -> tuple[DataFrame, DataFrame]:
    """(run, id, label) and (run, src, dst) with src < dst: settled cells by number in settled order from 0."""
    cells = s.done().join(d.patterns.select(F.col("id").alias("pattern"), "label"), "pattern").select("run", "cell", F.col("placed").alias("pos"), "pattern", "label")
    return C.exported(cells, s.near)
