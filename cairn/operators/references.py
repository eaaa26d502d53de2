"""Orphan references: keys that name no live row of another table.

A reference may have several columns and any of them may be null. References
are grouped by null mask; each mask is anti-joined on its non-null columns under
the declared match semantics:

``simple``   a reference with any null column is satisfied (SQL's default),
``partial``  the non-null columns must occur together in some parent row; all
             columns null is satisfied,
``full``     all columns null is satisfied, some null is a violation, none null
             must occur in the parent.

References to the same parent columns share one exchange: they are stacked into
one long table first. The parent side is reduced before it is shuffled: to
distinct keys, or with validity to disjoint intervals per key, and cut to the shared
folder. Both inputs of the anti-join are then plain exchanges, which is what AQE needs
to split the partition of a hot referenced key; an aggregate between exchange and join
would keep it whole.

Defined results: an empty child gives no rows; with an empty parent every
reference that needs a match is an orphan; repeated child rows are reported once
each; values compare exactly (no trimming, no case folding). Null ``at`` or null
``valid_from`` is never covered, so such a reference is an orphan. Other columns
of either table, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Reference:
    """``columns`` of the child name ``parent_columns`` of the parent."""

    name: str
    columns: tuple[str, ...]
    parent_columns: tuple[str, ...]
    match: str = "simple"

    def __post_init__(self) -> None:
        if len(self.columns) != len(self.parent_columns) or not self.columns:
            raise ValueError("a reference needs as many columns as parent columns")
        if self.match not in ("simple", "partial", "full"):
            raise ValueError(f"unknown match semantics: {self.match}")


@dataclass(frozen=True)
class Validity:
    """A parent row counts from ``start`` until before ``end`` (null: no end); a reference is looked up at ``at``."""

    at: str
    start: str
    end: str


def _merged(parents: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Overlapping or touching [_from, _to) of equal ``keys`` and ``within`` become one."""
    by = Window.partitionBy(*keys, *within).orderBy("_from", "_to")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("_to").over(before)
    marked = parents.withColumn("_new", F.when(F.col("_from") <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by))
    return marked.groupBy(*keys, *within, "_run").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")).drop("_run")


def _intervals(parent: DataFrame, columns: Sequence[str], validity: Validity) -> DataFrame:
    """Disjoint validity per key: one open interval from a plain minimum, ended ones merged by month and then over months."""
    keys = [f"_k{i}" for i in range(len(columns))]
    rows = parent.select(*(F.col(c).alias(k) for c, k in zip(columns, keys)), F.col(validity.start).alias("_from"), F.col(validity.end).alias("_to"))
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & F.col("_from").isNotNull())
    still = rows.where(F.col("_to").isNull()).groupBy(*keys).agg(F.min("_from").alias("_from")).withColumn("_to", F.lit(None).cast(rows.schema["_to"].dataType))
    ended = rows.where(F.col("_to") > F.col("_from")).withColumn("_month", F.date_trunc("month", F.col("_from")))
    ended = _merged(_merged(ended, keys, ["_month"]).drop("_month"), keys, [])
    return still.select(*keys, "_from", "_to").unionByName(ended.select(*keys, "_from", "_to"))


def orphan_references(child: DataFrame, parent: DataFrame, references: Sequence[Reference], key: Sequence[str], keep: Sequence[str] = (), validity: Validity | None = None) -> DataFrame:
    """One row per child row and reference without a parent.

    Columns: ``key``, ``keep``, ``reference`` (its name) and ``null_mask`` (one
    character per column, ``1`` where it is null).
    """
    if clash := ({"reference", "null_mask"} & {*key, *keep}):
        raise ValueError(f"reserved output columns: {sorted(clash)}")
    out = [*dict.fromkeys([*key, *keep])]
    probes: dict[tuple[str, ...], list[Column]] = defaultdict(list)
    violations: list[Column] = []
    for ref in references:
        width = len(ref.columns)
        for mask in range(2**width):
            present = [i for i in range(width) if not mask >> i & 1]
            in_mask = reduce(lambda a, b: a & b, [F.col(c).isNull() if mask >> i & 1 else F.col(c).isNotNull() for i, c in enumerate(ref.columns)])
            label = "".join(str(mask >> i & 1) for i in range(width))
            if not present or (ref.match == "simple" and mask):
                continue
            if ref.match == "full" and mask:
                violations.append(F.when(in_mask, F.struct(F.lit(ref.name).alias("reference"), F.lit(label).alias("null_mask"))))
                continue
            fields = [F.col(ref.columns[i]).alias(f"_k{n}") for n, i in enumerate(present)]
            probes[tuple(ref.parent_columns[i] for i in present)].append(F.when(in_mask, F.struct(F.lit(ref.name).alias("reference"), F.lit(label).alias("null_mask"), *fields)))
    parts = []
    at = [F.col(validity.at).alias("_at")] if validity else []
    for parent_columns, stacked in probes.items():
        keys = [f"_k{i}" for i in range(len(parent_columns))]
        several = child.select(*out, *at, F.explode(F.filter(F.array(*stacked), lambda x: x.isNotNull())).alias("_r")) if len(stacked) > 1 else child.select(*out, *at, stacked[0].alias("_r")).where(F.col("_r").isNotNull())
        left = several.select(*out, *(c for c in ("_at",) if validity), "_r.reference", "_r.null_mask", *(F.col(f"_r.{k}").alias(k) for k in keys))
        if validity:
            right = _intervals(parent, parent_columns, validity)
            right = cut(right.select(*(F.col(k).alias(f"_p{k}") for k in keys), "_from", "_to"))
            match = (F.col("_from") <= F.col("_at")) & (F.col("_to").isNull() | (F.col("_to") > F.col("_at")))
        else:
            right = cut(parent.select(*(F.col(c).alias(f"_p{k}") for c, k in zip(parent_columns, keys))).dropna().distinct())
            match = F.lit(True)
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_p{k}") for k in keys])
        parts.append(left.join(right, on & match, "left_anti").select(*out, "reference", "null_mask"))
    if violations:
        parts.append(child.select(*out, F.explode(F.filter(F.array(*violations), lambda x: x.isNotNull())).alias("_r")).select(*out, "_r.reference", "_r.null_mask"))
    if not parts:
        return child.select(*out, F.lit("").alias("reference"), F.lit("").alias("null_mask")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def orphan_causes(orphans: DataFrame, parent: DataFrame, references: Sequence[Reference], validity: Validity) -> DataFrame:
    """``orphans`` with their ``cause``; they must have kept the references' columns and the time.

    ``missing``: no parent row has the key; ``late``: the first that has it counts only after the reference's time; ``deleted``:
    a parent counted before and has ended. A reference without a time is ``untimed``. For whole references (no null in them)
    to the same parent columns; others have no cause.
    """
    if len({r.parent_columns for r in references}) != 1:
        raise ValueError("causes are told for references to the same parent columns")
    keys = [f"_k{i}" for i in range(len(references[0].parent_columns))]
    whole = reduce(lambda a, b: a | b, [(F.col("reference") == r.name) & (F.col("null_mask") == "0" * len(keys)) for r in references])
    named = orphans.withColumns({k: F.when(whole, F.coalesce(*(F.when(F.col("reference") == r.name, F.col(r.columns[i])) for r in references))) for i, k in enumerate(keys)})
    known = parent.where(F.col(validity.start).isNotNull()).groupBy(*(F.col(c).alias(f"_p{k}") for c, k in zip(references[0].parent_columns, keys))).agg(F.min(validity.start).alias("_first"))
    joined = named.join(cut(known), reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_p{k}") for k in keys]), "left")
    at = F.col(validity.at)
    cause = F.when(F.col(keys[0]).isNull(), None).when(F.col("_first").isNull(), "missing").when(at.isNull(), "untimed").when(F.col("_first") > at, "late").otherwise("deleted")
    return joined.select(*orphans.columns, cause.alias("cause"))


def orphan_report(orphans: DataFrame, table: str, at: str, period: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Orphans counted by table, reference, period of ``at`` and the columns ``by``; rows without a time count under a null period."""
    when = F.date_format(F.date_trunc(period, F.col(at)), {"year": "yyyy", "month": "yyyy-MM"}.get(period, "yyyy-MM-dd"))
    return orphans.groupBy(F.lit(table).alias("table_name"), F.col("reference"), when.alias("period"), *by).agg(F.count("*").alias("orphans"))
