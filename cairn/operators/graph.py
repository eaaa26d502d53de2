"""Operators on typed edges between evidence nodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import EVIDENCE_ORDER, missing, ranked, raw_of
from .references import Reference, orphan_references

# The relations that a summary counts even where there are none.
RELATIONS = ["supports", "supplements", "updates", "confirms", "cautions"]
# What a node must have.
REQUIRED = ["id", "title", "evidence_type", "year", "main_findings"]


def induced(edges: DataFrame, selected: DataFrame, by: Sequence[str] = (), node: str = "id") -> DataFrame:
    """Edges with both ends among the selected nodes, for each value of ``by`` (such as a question).

    Two semi joins where there is no ``by``. The selection is cut to the shared folder, so that the joins read plain
    exchanges and AQE can split the partition of a hot end.
    """
    ends = cut(selected.select(*by, F.col(node).alias("_node")).where(F.col("_node").isNotNull()).distinct())
    if not by:
        return edges.join(ends, F.col("source") == F.col("_node"), "left_semi").join(ends, F.col("target") == F.col("_node"), "left_semi")
    first = edges.join(ends, F.col("source") == F.col("_node")).drop("_node")
    second = ends.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_node"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in by])
    return first.join(second, (F.col("target") == F.col("_node")) & same, "left_semi")


def induced_each(edges: DataFrame, selected: DataFrame, by: str, node: str = "id") -> DataFrame:
    """All columns of ``edges`` once for each value of ``by`` (such as a question) whose selection has both ends.

    An end carries the list of its values of ``by``, so that edges are shuffled once each and multiply only in the result;
    for a stated set of values. The lists are cut to the shared folder for the reason given above.
    """
    named = selected.where(F.col(node).isNotNull())
    ends = cut(named.groupBy(F.col(node).alias("_node")).agg(F.collect_set(by).alias("_by")))
    targets = ends.select(F.col("_node").alias("_other"), F.col("_by").alias("_with"))
    both = edges.join(ends, F.col("source") == F.col("_node")).join(targets, F.col("target") == F.col("_other"))
    return both.select(F.explode(F.array_intersect("_by", "_with")).alias(by), *edges.columns)


def relation_counts(edges: DataFrame) -> DataFrame:
    """Edges by relation, the known relations even without edges; a null relation is counted as null."""
    known = edges.sparkSession.createDataFrame([(r,) for r in RELATIONS], "relation string").withColumn("edges", F.lit(0).cast("bigint"))
    counts = edges.groupBy("relation").agg(F.count("*").alias("edges"))
    return counts.unionByName(known).groupBy("relation").agg(F.sum("edges").alias("edges"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the number of nodes and edges, and whether the graph is valid."""
    sizes = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    bad = violations(nodes, edges).limit(1).agg(F.count("*").alias("_bad"))
    return sizes.crossJoin(bad).select("nodes", "edges", (F.col("_bad") == 0).alias("graph_valid"))


def edges_by_relation(edges: DataFrame) -> DataFrame:
    """Edges with their position from 1 within their relation, in the order of their row key."""
    named = edges.withColumn("_relation", F.coalesce("relation", F.lit("")))
    return ranked(named, [F.col("_ord").alias("_row")], within=["_relation"], name="position").drop("_relation", "_row")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that names no node, or is null: ``_ord`` and ``endpoint``."""
    orphans = orphan_references(edges, nodes, [Reference("source", ("source",), ("id",)), Reference("target", ("target",), ("id",))], ["_ord"])
    nulls = edges.select("_ord", F.explode(F.filter(F.array(F.when(F.col("source").isNull(), F.lit("source")), F.when(F.col("target").isNull(), F.lit("target"))), lambda x: x.isNotNull())).alias("endpoint"))
    return orphans.select("_ord", F.col("reference").alias("endpoint")).unionByName(nulls)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """The node itself and the other ends of its edges, each once."""
    at = (F.col("source") == node) | (F.col("target") == node)
    ends = edges.where(at).select(F.explode(F.array("source", "target")).alias("id")).where(F.col("id").isNotNull())
    own = edges.sparkSession.createDataFrame([(node,)], "id string")
    return ends.unionByName(own).distinct()


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids of more than one row; a missing id is an id."""
    return nodes.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All that keeps a graph from being valid: ``check``, ``row`` (null for an id) and ``detail``.

    Where the records are there as they came (``_raw``), a required key with a JSON null isn't missing.
    """
    twice = duplicate_ids(nodes).select(F.lit("duplicate_id").alias("check"), F.lit(None).cast("bigint").alias("row"), F.col("id").alias("detail"))
    lacking = F.filter(F.array(*(F.when(missing(c, raw_of(nodes)), F.lit(c)) for c in sorted(REQUIRED))), lambda x: x.isNotNull())
    without = nodes.select(F.lit("missing_field").alias("check"), F.col("_ord").alias("row"), F.explode(lacking).alias("detail"))
    kinds = nodes.where(F.col("evidence_type").isNotNull() & ~F.col("evidence_type").isin(*EVIDENCE_ORDER)).select(F.lit("unknown_type").alias("check"), F.col("_ord").alias("row"), F.col("evidence_type").alias("detail"))
    ends = dangling(edges, nodes).select(F.lit("dangling_edge").alias("check"), F.col("_ord").alias("row"), F.col("endpoint").alias("detail"))
    return reduce(DataFrame.unionByName, [twice, without, kinds, ends])
