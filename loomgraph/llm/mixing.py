"""Mixing sources to target weights by entropy balancing (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, words

#: More sources than this are joined by a salted shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000
SALTS = 16
#: Shares of a copy are summed as whole numbers of this unit, which are the same in any order.
ONE = 1 << 30
#: Documents of one rounding bucket, on average.
BUCKET_ROWS = 5_000


def source_targets(hist: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """Per source: size, target. Targets share the total by weight, at most max_repeat times the size.

    The capped sources are those of smallest cap per weight, so running sums in that order
    give the final share without repeating the redistribution. One row per source.
    """
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", weight)
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("share", F.when(F.col("cap") / F.col("w") >= F.col("left") / F.col("left_w"), F.col("left") / F.col("left_w")))
        .withColumn("share", F.max("share").over(everything))
    )
    return per.select("source", "source_size", "source_docs", F.coalesce(F.least("cap", F.col("share") * F.col("w")), F.col("cap")).alias("target"))


def solve(hist: DataFrame, targets: DataFrame, max_repeat: int, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """targets plus `tilt`, the dual variable of each source.

    A document of x times its source's mean size gets the rate min(max_repeat, exp(tilt * x)),
    which minimises the sum of r ln r - r under sum of r * size = target and r <= max_repeat.
    Newton steps on the logarithm of the constraint, kept in a bracket; every step is one
    aggregation of the (source, size) histogram, so its cost is that of the distinct sizes.
    """
    kept = ["source_size", "source_docs", "target", "mean", "tilt", "lo", "hi"]
    state = targets.withColumns({"mean": F.when(F.col("source_size") > 0, F.col("source_size") / F.col("source_docs")).otherwise(1.0), "tilt": F.lit(0.0), "lo": F.lit(-1e6), "hi": F.lit(1e6)})
    state = cut(state.withColumnRenamed("source", "s"))
    top = F.lit(float(max_repeat))
    x = F.col("size") / F.col("mean")
    u = F.col("tilt") * x
    rate = F.when(u >= F.log(top), top).otherwise(F.exp(u))
    slope = F.when(u >= F.log(top), F.lit(0.0)).otherwise(F.exp(u) * x)
    for _ in range(steps):
        new = hist.join(state, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * F.coalesce(rate, F.lit(0.0))).alias("m"),
            F.sum(F.col("n") * F.col("size") * F.coalesce(slope, F.lit(0.0))).alias("dm"),
            *[F.first(c).alias(c) for c in kept],
        )
        new = new.withColumn("lo", F.when(F.col("m") < F.col("target"), F.col("tilt")).otherwise(F.col("lo")))
        new = new.withColumn("hi", F.when(F.col("m") > F.col("target"), F.col("tilt")).otherwise(F.col("hi")))
        step = F.col("tilt") + F.when((F.col("dm") > 0) & (F.col("m") > 0), F.log(F.col("target") / F.col("m")) * F.col("m") / F.col("dm"))
        inside = step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi"))
        middle = F.when(F.col("lo") <= -1e6, F.least(F.col("tilt") * 2, F.col("tilt") - 1)).when(F.col("hi") >= 1e6, F.greatest(F.col("tilt") * 2, F.col("tilt") + 1)).otherwise((F.col("lo") + F.col("hi")) / 2)
        gap = F.when(F.col("target") > 0, F.abs(F.col("m") / F.col("target") - 1)).otherwise(0.0)
        new = new.withColumn("gap", gap).withColumn("tilt", F.when(F.col("gap") <= tolerance, F.col("tilt")).when(inside, step).otherwise(middle))
        state = cut(new.drop("m", "dm").withColumnRenamed("source", "s"))
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise ValueError(f"the rates did not reach the targets in {steps} steps")
    # Sums of doubles differ in their last digits from run to run; the rounded tilt does not.
    state = state.withColumn("tilt", F.round("tilt", 9))
    state = state.withColumnRenamed("s", "source")
    return state.select("source", "source_size", "source_docs", "target", "mean", "tilt")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """Each row's copies in the mix; the rows of `docs` with size, source_size, target, rate, copies, taken.

    Null and empty texts, and sources of nothing else, have size 0 and no copies; a null source is a source of its own; an
    empty table gives an empty result; repeated rows count as often as they occur. Columns named
    like the computed ones are replaced. Rates become whole copies by systematic rounding along
    each source's documents in order of size: running sums inside buckets of about BUCKET_ROWS
    rows plus the buckets' offsets, so no source is ever held by one task, and the total is
    off by no more than about one of its largest documents. Which rows of a bucket get the extra
    copies follows from doc_id and the row's place in `docs`, so that reruns agree.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies", "taken")
    # The table's own columns go by number meanwhile, so that none can clash with a working one.
    own = [f"__own{k}" for k in range(len(docs.columns))]
    sized = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, own)), *(docs[c].alias(c) for c in ("doc_id", "source")), F.size(words("text")).cast("long").alias("size"), F.monotonically_increasing_id().alias("__row"))
    hist = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    solved = solve(hist, source_targets(hist, weights, max_repeat), max_repeat)
    solved = cut(solved.withColumn("buckets", F.ceil(F.col("source_docs") / BUCKET_ROWS)).withColumnRenamed("source", "s"))
    if solved.count() <= BROADCAST_SOURCES:
        rows = sized.join(F.broadcast(solved), F.col("source").eqNullSafe(F.col("s")))
    else:
        salted = solved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = sized.withColumn("salt0", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt0") == F.col("salt"))).drop("salt", "salt0")
    u = F.col("tilt") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 0.0).when(u >= F.log(F.lit(float(max_repeat))), float(max_repeat)).otherwise(F.exp(u))
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.floor(F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")) * ONE))
    rows = rows.withColumn("bin", F.floor(F.log2(F.col("size") + 1) * 8)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "__row", F.lit(seed)), F.col("buckets")))
    sums = rows.groupBy("s", "bin", "bucket").agg(F.sum("part").alias("bucket_sum"))
    order = Window.partitionBy("s").orderBy("bin", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("bucket_sum").over(order), F.lit(0)))
    sums = sums.select(F.col("s").alias("s2"), F.col("bin").alias("bin2"), F.col("bucket").alias("bucket2"), "offset")
    inside = Window.partitionBy("s", "bin", "bucket").orderBy("size", "doc_id", "__row")
    rows = rows.withColumn("run", F.sum("part").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(sums, F.col("s").eqNullSafe(F.col("s2")) & (F.col("bin") == F.col("bin2")) & (F.col("bucket") == F.col("bucket2")))
    end = F.col("offset") + F.col("run")
    extra = F.floor((end + ONE // 2) / ONE) - F.floor((end - F.col("part") + ONE // 2) / ONE)
    rows = rows.withColumn("copies", F.least(F.lit(max_repeat), F.col("whole") + extra).cast("int"))
    return rows.withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, own)), "size", "source_size", "target", "rate", "copies", "taken")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1, repeating, by source."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
