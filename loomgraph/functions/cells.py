"""Column functions of the generator's cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(weights: Column) -> Column:
    """Natural-log Shannon entropy of an array of weights; 0 for one weight or no total."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.greatest(w, F.lit(0)).cast("double"))
    h = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.when(w > 0, -(w / total) * F.log(w / total)).otherwise(0.0))
    return F.when((F.size(weights) <= 1) | (total <= 0), 0.0).otherwise(h)


def linear_decay(share: Column, lower: float = 1.0, upper: float = 1.1) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(upper) - share) / F.lit(upper - lower)))


def prune(domain: Column, allowed: Column) -> Column:
    return F.array_intersect(domain, allowed)


def base_slots(degree: Column, demand: Column, budget: Column) -> Column:
    return F.least(F.greatest(F.lit(1), F.floor(budget * degree / demand)), F.floor((degree + 1) / 2))
