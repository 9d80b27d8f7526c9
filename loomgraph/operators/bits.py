"""Domains and compatibility as packed bits.

A pattern is a bit of a word of 64, a set of patterns the rows (word, bits) of its words that are not
0. Equal sets are stored once, under a name made of their content. A dictionary holds, for each
radius, the profiles of its keys, the sets of paths they go out by: patterns of one profile share one
set of partners, itself left out of each. Pairs of patterns are never listed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import gathered
from .numbering import numbered

#: The name of the set without patterns.
EMPTY = ""


@dataclass
class Dictionary:
    """patterns(id, word, mask, label, frequency, degree), profiles(radius, a, profile) of the keys,
    masks(radius, profile, word, bits) of their partners, out(a, path) and into(path, b) of radius 1."""

    patterns: DataFrame
    profiles: DataFrame
    masks: DataFrame
    out: DataFrame
    into: DataFrame
    radius: int


def with_bits(patterns: DataFrame) -> DataFrame:
    """The patterns with the word and the bit of each, by ascending id."""
    rows = numbered(patterns, ["id"], "__index")
    return gathered(rows.withColumns({"word": F.expr("__index div 64"), "mask": F.expr("shiftleft(1L, cast(__index % 64 as int))")}).drop("__index"))


def from_paths(patterns: DataFrame, keys: DataFrame, paths: DataFrame, radius: int) -> Dictionary:
    """The dictionary of patterns(id, label, frequency, degree), keys(radius, a), paths(radius, id, path)."""
    paths = gathered(paths.select("radius", "id", F.array_join("path", ",").alias("path"), F.array_join(F.reverse("path"), ",").alias("back")).distinct())
    bits = with_bits(patterns)
    by_set = paths.groupBy("radius", F.col("id").alias("a")).agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(path))").alias("h1"), F.expr("bit_xor(xxhash64(path, 1))").alias("h2"))
    signs = ["radius", "n", "h1", "h2"]
    signed = gathered(keys.join(by_set, ["radius", "a"], "left").na.fill(0, ["n", "h1", "h2"]))
    profiles = gathered(signed.join(signed.groupBy(*signs).agg(F.min("a").alias("profile")), signs).select("radius", "a", "profile"))
    by_path = paths.join(bits, "id").groupBy("radius", F.col("back").alias("path"), "word").agg(F.expr("bit_or(mask)").alias("bits"))
    of_profile = paths.join(profiles.select("radius", F.col("profile").alias("id")).distinct(), ["radius", "id"]).select("radius", F.col("id").alias("profile"), "path")
    masks = gathered(of_profile.join(by_path, ["radius", "path"]).groupBy("radius", "profile", "word").agg(F.expr("bit_or(bits)").alias("bits")))
    near = paths.where("radius = 1")
    return Dictionary(bits, profiles, masks, near.select(F.col("id").alias("a"), "path"), near.select(F.col("back").alias("path"), F.col("id").alias("b")), radius)


def from_pairs(patterns: DataFrame, keys: DataFrame, compat: DataFrame, radius: int) -> Dictionary:
    """The dictionary of compatible pairs compat(radius, a, b) that no paths are known of."""
    bits = with_bits(patterns)
    masks = compat.join(bits.withColumnRenamed("id", "b"), "b").groupBy("radius", F.col("a").alias("profile"), "word").agg(F.expr("bit_or(mask)").alias("bits"))
    one = compat.where("radius = 1")
    return Dictionary(bits, gathered(keys.select("radius", "a", F.col("a").alias("profile"))), gathered(masks), one.select("a", F.col("a").cast("string").alias("path")), one.select(F.col("a").cast("string").alias("path"), "b"), radius)


def _name() -> Column:
    """The name of a set, over its rows (word, bits)."""
    return F.expr("concat(hex(bit_xor(xxhash64(word, bits))), '-', hex(bit_xor(xxhash64(bits, word, 1))))")


def full_set(d: Dictionary) -> tuple[str, DataFrame]:
    """The set of all patterns: its name and rows (domain, word, bits)."""
    words = gathered(d.patterns.groupBy("word").agg(F.expr("bit_or(mask)").alias("bits")))
    name = words.agg(_name().alias("domain")).first()["domain"] or EMPTY
    return name, words.select(F.lit(name).alias("domain"), "word", "bits")


def packed(domains: DataFrame, d: Dictionary) -> tuple[DataFrame, DataFrame]:
    """(cell, domain) and the sets (domain, word, bits) of cells with arrays of patterns in `domain`."""
    words = domains.select("cell", F.explode("domain").alias("id")).join(d.patterns, "id").groupBy("cell", "word").agg(F.expr("bit_or(mask)").alias("bits"))
    words = gathered(words)
    names = words.groupBy("cell").agg(_name().alias("domain"))
    named = gathered(domains.select("cell").join(names, "cell", "left").na.fill(EMPTY, ["domain"]))
    one = named.groupBy("domain").agg(F.min("cell").alias("cell"))
    return named, words.join(one, "cell").select("domain", "word", "bits")


def pruned_sets(cells: DataFrame, sets: DataFrame, rules: DataFrame, d: Dictionary) -> tuple[DataFrame, DataFrame]:
    """(cell, domain) of the cells that a rule touches, and the sets (domain, word, bits) they have now.

    cells(cell, domain), sets(domain, word, bits), rules(cell, radius, a): pattern a is settled `radius`
    away. A pattern without a key at that radius forbids nothing. Cells of one set under the same rules
    are pruned once: the masks of the rules' profiles meet in a bit-and aggregate, where a word that a
    mask lacks is 0, and the bits of the rules' own patterns are taken out.
    """
    rules = gathered(rules.join(d.profiles, ["radius", "a"]).select("cell", "radius", "a", "profile").distinct())
    under = rules.groupBy("cell").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(radius, a))").alias("h1"), F.expr("bit_xor(xxhash64(a, radius, 1))").alias("h2"))
    touched = cells.join(under, "cell")
    case = ["domain", "n", "h1", "h2"]
    cases = gathered(touched.groupBy(*case).agg(F.min("cell").alias("cell")))
    ruled = rules.join(cases.select("cell"), "cell")
    masks = ruled.select("cell", "radius", "profile").distinct()
    every = masks.groupBy("cell").agg(F.count("*").alias("most"))
    allowed = masks.join(d.masks, ["radius", "profile"]).groupBy("cell", "word").agg(F.expr("bit_and(bits)").alias("allowed"), F.count("*").alias("masks")).join(every, "cell").where("masks = most")
    own = ruled.select("cell", F.col("a").alias("id")).distinct().join(d.patterns, "id").groupBy("cell", "word").agg(F.expr("bit_or(mask)").alias("own"))
    words = cases.select("cell", "domain").join(sets, "domain").join(allowed, ["cell", "word"]).join(own, ["cell", "word"], "left")
    words = gathered(words.select("cell", "word", F.expr("bits & allowed & ~coalesce(own, 0L)").alias("bits")).where("bits <> 0"))
    names = cases.join(words.groupBy("cell").agg(_name().alias("new")), "cell", "left").na.fill(EMPTY, ["new"]).select(*case, "cell", "new")
    one = names.groupBy("new").agg(F.min("cell").alias("cell"))
    new_sets = words.join(one, "cell").select(F.col("new").alias("domain"), "word", "bits")
    return touched.join(names.drop("cell"), case).select("cell", F.col("new").alias("domain")), new_sets


def members(sets: DataFrame, d: Dictionary) -> DataFrame:
    """(domain, id, frequency) of the patterns in the sets."""
    return sets.join(d.patterns, "word").where("(bits & mask) <> 0").select("domain", "id", "frequency")


def singles(sets: DataFrame, d: Dictionary) -> DataFrame:
    """(domain, pattern) of the sets with one pattern."""
    one = sets.groupBy("domain").agg(F.sum(F.bit_count("bits")).alias("n"), F.min("word").alias("word"), F.min("bits").alias("mask")).where("n = 1")
    return one.join(d.patterns, ["word", "mask"]).select("domain", F.col("id").alias("pattern"))


def set_entropies(sets: DataFrame, d: Dictionary) -> DataFrame:
    """(domain, total, entropy) of the sets with two patterns or more, by frequency, to nine places."""
    sums = members(sets, d).where("frequency > 0").groupBy("domain").agg(F.count("*").alias("n"), F.sum("frequency").alias("total"), F.sum(F.round(F.col("frequency") * F.log("frequency"), 9).cast("decimal(38,9)")).cast("double").alias("w"))
    return sums.where("n > 1").select("domain", "total", F.round(F.log("total") - F.col("w") / F.col("total"), 9).alias("entropy"))


def allowed_pairs(pairs: DataFrame, d: Dictionary) -> DataFrame:
    """The rows of pairs(radius, a, b, ...) where b is a partner of a at that radius."""
    bit = d.patterns.select(F.col("id").alias("b"), "word", "mask")
    rows = pairs.where("a <> b").join(d.profiles, ["radius", "a"]).join(bit, "b").join(d.masks, ["radius", "profile", "word"])
    return rows.where("(bits & mask) <> 0").select(*pairs.columns)


def partner_scores(pairs: DataFrame, d: Dictionary) -> DataFrame:
    """(a, b, score) of pairs(a, b): the sum over common partners at radius 1 of 1 / how many partners these have.

    Only the given pairs are scored, by the bits their two sets share.
    """
    one = d.profiles.where("radius = 1").select("a", "profile")
    masks = d.masks.where("radius = 1").select("profile", "word", "bits")
    own = d.patterns.select("id", F.col("word").alias("own_word"), "mask")
    sizes = one.join(masks.groupBy("profile").agg(F.sum(F.bit_count("bits")).alias("n")), "profile")
    selves = one.join(own, F.col("a") == F.col("id")).join(masks, (one["profile"] == masks["profile"]) & (F.col("word") == F.col("own_word"))).where("(bits & mask) <> 0").select("a", F.lit(1).alias("self"))
    degree = sizes.join(selves, "a", "left").select(F.col("a").alias("id"), (F.col("n") - F.coalesce("self", F.lit(0))).alias("partners"))
    both = pairs.select("a", "b").distinct().join(one.withColumnRenamed("profile", "pa"), "a").join(one.select(F.col("a").alias("b"), F.col("profile").alias("pb")), "b")
    shared = both.join(masks.select(F.col("profile").alias("pa"), "word", F.col("bits").alias("x")), "pa").join(masks.select(F.col("profile").alias("pb"), "word", F.col("bits").alias("y")), ["pb", "word"])
    shared = shared.withColumn("bits", F.expr("x & y")).where("bits <> 0").join(d.patterns, "word").where("(bits & mask) <> 0 and id <> a and id <> b")
    return shared.join(degree, "id").groupBy("a", "b").agg(F.round(F.sum(1 / F.col("partners")), 9).alias("score"))
