"""Additive rules: a score is the sum of the weights of the predicates that hold, with their labels as reasons.

A rule set is data (predicate, weight, label); a cut-off list turns the score into a level. All rules of a
set become one projection, so any number of sets is one pass without a shuffle. What the weights
and cut-offs are is the user's matter: rule sets are parameters, none come with the library.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    when: Column
    weight: float
    label: str


def at_least(column: Column, value: float) -> Column:
    """``column >= value``; false for null and for NaN, which Spark takes for the largest number."""
    return F.coalesce(~F.isnan(column) & (column >= value), F.lit(False))


def below(column: Column, value: float) -> Column:
    return F.coalesce(column < value, F.lit(False))


def level(score: Column, cuts: Sequence[tuple[float, str]], lowest: str) -> Column:
    """The label of the first cut that the score reaches; cuts from high to low."""
    out = F
    for at, label in cuts:
        out = out.when(score >= at, F.lit(label))
    return out.otherwise(F.lit(lowest)) if cuts else F.lit(lowest)


def apply_rules(df: DataFrame, rules: Sequence[Rule], cuts: Sequence[tuple[float, str]], lowest: str, name: str, cap: float | None = None) -> DataFrame:
    """Adds ``<name>_score``, ``<name>_level`` and ``<name>_reasons``. The level is of the unrounded score; an undecided predicate doesn't hold."""
    holds = [F.coalesce(r.when, F.lit(False)) for r in rules]
    points = reduce(lambda a, b: a + b, [F.when(h, F.lit(float(r.weight))).otherwise(F.lit(0.0)) for h, r in zip(holds, rules)], F.lit(0.0))
    points = points if cap is None else F.least(points, F.lit(float(cap)))
    reasons = F.filter(F.array(*(F.when(h, F.lit(r.label)) for h, r in zip(holds, rules))), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return df.withColumn(f"{name}_score", F.round(points, 3)).withColumn(f"{name}_level", level(points, cuts, lowest)).withColumn(f"{name}_reasons", reasons)
