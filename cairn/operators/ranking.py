"""Evidence order: vocabularies, the pyramid rank, positions within types.

A rank over a whole table is a distributed sort: rows are range-partitioned, numbered within their
partition and shifted by the rows before it, so no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Evidence types and qualities from the strongest to the weakest, with their labels.
EVIDENCE_ORDER = {
    "guideline": 0,
    "systematic_review": 1,
    "randomized_controlled_trial": 2,
    "observational_study": 3,
    "narrative_review": 4,
    "case_report": 5,
}
EVIDENCE_LABELS = {
    "guideline": "指南",
    "systematic_review": "系统综述/Meta 分析",
    "randomized_controlled_trial": "随机对照试验（RCT）",
    "observational_study": "观察性研究",
    "narrative_review": "叙述性综述",
    "case_report": "病例报告",
}
QUALITY_ORDER = {"high": 0, "moderate": 1, "low": 2, "very_low": 3}
UNKNOWN_TYPE, UNKNOWN_QUALITY = 6, 9
MISSING_QUALITY = QUALITY_ORDER["low"]


def lookup(column: Column, values: Mapping[str, object], default: object = None) -> Column:
    """The value for a key, from a literal map."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, F.lit(default))


def type_order(column: Column) -> Column:
    """0 to 5; unknown and null types come after all known ones."""
    return lookup(column, EVIDENCE_ORDER, UNKNOWN_TYPE)


def missing(name: str, raw: str | None = None) -> Column:
    """Whether a record lacks a key. With the record as it came, a key whose value is JSON null isn't missing; in a table a null is."""
    null = F.col(name).isNull()
    if raw is None:
        return null
    # JSON null and a value of another type are null in the typed column, but their key is there.
    return null & F.coalesce(F.try_variant_get(F.try_parse_json(F.col(raw)), f"$.{name}", "variant").isNull(), F.lit(True))


def raw_of(df: DataFrame) -> str | None:
    return "_raw" if "_raw" in df.columns else None


def quality_order(column: Column, absent: Column | None = None) -> Column:
    """0 to 3; a missing quality counts as low, an unknown one (a JSON null among them) comes last."""
    found = lookup(column, QUALITY_ORDER, UNKNOWN_QUALITY)
    return F.when(column.isNull() if absent is None else absent, MISSING_QUALITY).otherwise(found)


def pyramid_keys(raw: str | None = None) -> list[Column]:
    """Type, quality (a missing one counts as low), newest first (a missing year or month counts as 0), id and row key."""
    return [
        type_order(F.col("evidence_type")).alias("_type"),
        quality_order(F.col("quality"), missing("quality", raw)).alias("_quality"),
        (-F.coalesce("year", F.lit(0))).alias("_year"),
        (-F.coalesce("month", F.lit(0))).alias("_month"),
        F.coalesce("id", F.lit("")).alias("_id"),
        F.col("_ord").alias("_row"),
    ]


def ranked(df: DataFrame, by: Sequence[Column], within: Sequence[str] = (), name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with its place from 1 in the order ``by``, within groups of equal ``within``.

    ``by`` must be a total order; its columns come out as well, under their aliases. All columns of ``df`` are
    shuffled and written to the shared folder once: select the needed ones before.
    """
    placed = df.select("*", *by)
    keys = [c for c in placed.columns if c not in df.columns]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(placed.repartitionByRange(n, *within, *keys).withColumn("_seg", F.spark_partition_id()))
    before = placed.groupBy("_seg", *within).agg(F.count("*").alias("_n"))
    shift = Window.partitionBy(*within).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_shift", F.coalesce(F.sum("_n").over(shift), F.lit(0))).drop("_n")
    local = placed.withColumn("_nth", F.row_number().over(Window.partitionBy("_seg", *within).orderBy(*keys)))
    return local.join(before, ["_seg", *within]).withColumn(name, (F.col("_nth") + F.col("_shift")).cast("bigint")).drop("_seg", "_nth", "_shift")


def pyramid(nodes: DataFrame) -> DataFrame:
    """All nodes with their place in the evidence pyramid."""
    return ranked(nodes, pyramid_keys(raw_of(nodes)), name="pyramid_rank")


def first_in_pyramid(nodes: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """The highest record, among those of ``types`` if given: a top-1, taken in each task first."""
    shown = nodes if types is None else nodes.where(F.col("evidence_type").isin(*types))
    return shown.orderBy(*pyramid_keys(raw_of(nodes))).limit(1)


def lane_positions(nodes: DataFrame) -> DataFrame:
    """``lane``, the number of the node's type among types that have nodes, and ``row_index`` from 0 within it, in pyramid order.

    Nodes of unknown types have no lane and are left out.
    """
    known = nodes.where(F.col("evidence_type").isin(*EVIDENCE_ORDER))
    present = known.select("evidence_type").distinct()  # six rows at most
    lanes = present.select(F.col("evidence_type").alias("_lane_type"), (F.row_number().over(Window.orderBy(type_order(F.col("evidence_type")))) - 1).cast("bigint").alias("lane"))
    order = ranked(known, pyramid_keys(raw_of(nodes)), within=["evidence_type"], name="_place")
    return order.join(F.broadcast(lanes), F.col("evidence_type") == F.col("_lane_type")).withColumn("row_index", F.col("_place") - 1).drop("_lane_type", "_place")


def type_inventory(nodes: DataFrame) -> DataFrame:
    """All types of the vocabulary, those without nodes included, with their labels and counts."""
    rows = [(k, o, EVIDENCE_LABELS[k]) for k, o in EVIDENCE_ORDER.items()]
    vocabulary = nodes.sparkSession.createDataFrame(rows, "key string, ord int, label string")
    counts = nodes.groupBy("evidence_type").agg(F.count("*").alias("nodes"))
    return vocabulary.join(counts, F.col("key") == F.col("evidence_type"), "left").select("key", "label", F.col("ord").cast("bigint").alias("ord"), F.coalesce("nodes", F.lit(0)).alias("nodes"))
