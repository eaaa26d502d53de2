"""Sequential hot-deck: missing values from the nearest similar record.

Within a group the records are sorted by a similarity key; a missing value takes
the nearest observed value before or after it and keeps the donor's key, the side
it came from and the distance in the sort key. A record never donates to another
delivery of itself (equal ``entity``).

Plan: the narrow projection is range-partitioned by (group, sort key), so a
group of any size is spread over as many partitions as its rows need, and cut to
the shared folder together with its partition number. Windows run inside a
(group, partition) segment. What a segment hands to the next one is two donors a
side, kept by one aggregate a segment and carried over segments by a window over
those summaries; only groups that cross a partition boundary have more than one,
at most two such groups a partition, so the carried table is broadcast: it holds
at most 2 x fields x partitions rows.

Defined results: null groups are neither filled nor donate; a null entity
counts as its own case, different from all others; a null sort key sorts first
and gives a null distance; ties in the sort key are ordered by the row key; of two
donors at the same distance the earlier one is taken, of which one with unknown
distance only if there is no other. NaN and values out of range are missing, and of a categorical field blank texts and values outside its list. An
empty table gives an empty result. Nothing is filled when the group has no usable
value of another entity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Usable:
    """A numeric field and the closed or half-open range of its possible values."""

    path: str
    low: float
    high: float
    low_open: bool = False
    kind = "double"

    def value(self) -> Column:
        v = F.col(self.path).cast("double")
        above = v > self.low if self.low_open else v >= self.low
        return F.when(v.isNotNull() & ~F.isnan(v) & above & (v <= self.high), v)


@dataclass(frozen=True)
class Category:
    """A categorical field: a text in lower case without spaces around it, one of ``values`` if they are given."""

    path: str
    values: tuple[str, ...] | None = None
    kind = "string"

    def value(self) -> Column:
        v = F.lower(F.trim(F.col(self.path).cast("string")))
        return F.when((v != "") if self.values is None else v.isin(*self.values), v)


def _two(d: DataFrame, side: str, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds, from the rows before each row: ``{side}1``, the last donor, ``{side}2``, the last one of another entity than that.

    ``{side}t`` holds, on donor rows that end a run of equal entities, the donor of that run.
    """
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn(f"{side}1", F.last("_donor", ignorenulls=True).over(before))
    turn = F.when(F.col("_donor.entity") != F.col(f"{side}1.entity"), F.col(f"{side}1"))
    return d.withColumn(f"{side}t", turn).withColumn(f"{side}2", F.last(f"{side}t", ignorenulls=True).over(before))


def _carried(ends: DataFrame, near: str, other: str, side: str, forward: bool) -> DataFrame:
    """What comes into each segment from all segments before it (after it, if not ``forward``).

    The two donors at a segment's end stand for all of its donors, the more distant one first.
    """
    line = ends.select("_group", "field_name", "_seg", F.posexplode(F.array(F.lit(None).cast(ends.schema[near].dataType), F.col(other), F.col(near))).alias("_pos", "_donor"))
    seg = F.col("_seg").asc() if forward else F.col("_seg").desc()
    line = _two(line, side, ["_group", "field_name"], [seg, F.col("_pos").asc()])
    return line.where("_pos = 0").select("_group", "field_name", "_seg", f"{side}1", f"{side}2")


def hot_deck(df: DataFrame, key: str, group: str, entity: str, fields: Mapping[str, Usable | Category], sort: Sequence[str], partitions: int | None = None) -> DataFrame:
    """One row per filled value.

    Columns: ``key``, ``field_name``, ``filled`` (the value; a text if there are categorical fields), ``donor`` (key of
    the donor row), ``side`` (``previous`` or ``next``), ``distance`` (difference
    of the first sort column, in seconds for timestamps).
    """
    kind = dict(df.dtypes)[sort[0]]
    number = F.unix_micros(F.col(sort[0]).cast("timestamp")) / F.lit(1e6) if kind.startswith(("timestamp", "date")) else F.col(sort[0]).cast("double")
    values = "string" if any(u.kind == "string" for u in fields.values()) else "double"
    narrow = df.where(F.col(group).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(group).alias("_group"),
        # a null entity is told apart by its row key
        F.coalesce(F.concat(F.lit("e"), F.col(entity).cast("string")), F.concat(F.lit("r"), F.col(key).cast("string"))).alias("_entity"),
        number.alias("_at"),
        *(F.col(c).alias(f"_s{i}") for i, c in enumerate(sort)),
        *(u.value().cast(values).alias(f"_v{i}") for i, u in enumerate(fields.values())),
    )
    order = [*(f"_s{i}" for i in range(len(sort))), "_key"]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(narrow.repartitionByRange(n, "_group", *order).withColumn("_seg", F.spark_partition_id()))

    # One row per (case, field) from here on. The rows are clustered by segment before they are expanded: that
    # serves all windows, which are partitioned by segment and field.
    long = placed.repartition("_group", "_seg").select(
        "_key", "_group", "_entity", "_at", "_seg", *order[:-1],
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_v{i}").alias("v")) for i, f in enumerate(fields)))).alias("_f"),
    ).select("*", F.col("_f.field").alias("field_name"), F.col("_f.v").alias("_v")).drop("_f")
    donor = F.struct(F.col("_entity").alias("entity"), F.col("_v").alias("v"), F.col("_key").alias("key"), F.col("_at").alias("at"))
    long = long.withColumn("_donor", F.when(F.col("_v").isNotNull(), donor))

    part = ["_group", "field_name", "_seg"]
    along, against = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]

    def sides(d: DataFrame) -> DataFrame:
        return _two(_two(d, "_p", part, along), "_n", part, against)

    crossing = placed.groupBy("_group").agg(F.min("_seg").alias("_a"), F.max("_seg").alias("_b")).where("_a < _b").select("_group")
    rank = F.struct(*order)
    ends = sides(long.join(F.broadcast(crossing), "_group", "left_semi")).groupBy(*part).agg(
        F.max_by("_donor", F.when(F.col("_donor").isNotNull(), rank)).alias("_last"),
        F.max_by("_pt", F.when(F.col("_pt").isNotNull(), rank)).alias("_last_other"),
        F.min_by("_donor", F.when(F.col("_donor").isNotNull(), rank)).alias("_first"),
        F.min_by("_nt", F.when(F.col("_nt").isNotNull(), rank)).alias("_first_other"),
    )
    carried = _carried(ends, "_last", "_last_other", "_cp", True).join(_carried(ends, "_first", "_first_other", "_cn", False), part)
    held = sides(long).join(F.broadcast(carried), part, "left")

    def pick(one: str, two_: str, far_one: str, far_two: str) -> Column:
        """The nearest of the four candidates of a side whose entity is not the row's own."""
        cands = [F.col(c) for c in (one, two_, far_one, far_two)]
        return F.coalesce(*(F.when(c.isNotNull() & (c["entity"] != F.col("_entity")), c) for c in cands))

    gaps = held.where(F.col("_v").isNull()).select("_key", "field_name", "_at", pick("_p1", "_p2", "_cp1", "_cp2").alias("_p"), pick("_n1", "_n2", "_cn1", "_cn2").alias("_n"))
    far = F.lit(float("inf"))
    dp, dn = F.coalesce(F.abs(F.col("_at") - F.col("_p.at")), far), F.coalesce(F.abs(F.col("_n.at") - F.col("_at")), far)
    back = F.col("_p").isNotNull() & (F.col("_n").isNull() | (dp <= dn))
    chosen = gaps.where(F.col("_p").isNotNull() | F.col("_n").isNotNull()).select(
        F.col("_key").alias(key), "field_name", F.when(back, F.col("_p")).otherwise(F.col("_n")).alias("_c"), F.when(back, F.lit("previous")).otherwise(F.lit("next")).alias("side"), "_at",
    )
    return chosen.select(key, "field_name", F.col("_c.v").alias("filled"), F.col("_c.key").alias("donor"), "side", F.abs(F.col("_at") - F.col("_c.at")).alias("distance"))


def fill_table(df: DataFrame, fills: DataFrame, key: str, fields: Mapping[str, Usable | Category], keep: Sequence[str] = ()) -> DataFrame:
    """The table with its gaps filled: ``key``, ``keep``, and for each field its value (usable or filled) and ``<field>_filled``."""
    wide = fills.groupBy(key).agg(*(F.max(F.when(F.col("field_name") == f, F.col("filled"))).cast(u.kind).alias(f"_f_{f}") for f, u in fields.items()))
    rows = df.select(key, *keep, *(u.value().alias(f"_u_{f}") for f, u in fields.items()))
    return rows.join(wide, key, "left").select(
        key, *keep, *(c for f in fields for c in (F.coalesce(F.col(f"_u_{f}"), F.col(f"_f_{f}")).alias(f), (F.col(f"_u_{f}").isNull() & F.col(f"_f_{f}").isNotNull()).alias(f"{f}_filled")))
    )
