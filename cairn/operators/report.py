"""Markdown reports and JSON payloads per question, from ranked evidence.

The wording (headings, notes before and after the lists) is a parameter; what the operator computes are the
inventory by type, the leading records of each type and the synthesis table. ``markdown`` and ``payload`` are top-k
views: they show the ``k`` highest records of a type and count the others. ``payload_rows`` and ``report_lines`` hold
all that a question retrieves, as rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import RELATIONS, induced_each
from .ranking import EVIDENCE_LABELS, EVIDENCE_ORDER, lookup, pyramid_keys, type_order
from .retrieval import NODE_FIELDS


# The fields of an edge, in their order.
EDGE_FIELDS = ["source", "target", "relation", "description"]

# The steps of a report; all but the first two and the last list the records of their types.
STEPS = ["question", "inventory", "guidelines", "reviews", "rct", "lower_evidence", "other_evidence", "synthesis"]
STEP_OF = {"guideline": 2, "systematic_review": 3, "randomized_controlled_trial": 4, "observational_study": 5, "narrative_review": 5, "case_report": 5}
OTHER_STEP = STEPS.index("other_evidence")


@dataclass(frozen=True)
class Wording:
    title: str = "## Question"
    inventory: str = "### Evidence found"
    records: str = "### Leading evidence"
    synthesis: str = "### Synthesis"
    table_head: str = "| type | records | role |\n|---|---:|---|"
    more: str = "- and %d more"
    relations: str = "Relations among the evidence: %d."
    relation: str = "- %s: %d"
    totals: str = "%d records, %d relations."
    other: str = "other"
    roles: Mapping[str, str] = field(default_factory=dict)
    labels: Mapping[str, str] = field(default_factory=lambda: EVIDENCE_LABELS)


def leading(retrieved: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Per question and known type: ``records`` and the ``k`` highest as ``lines``; the limit applies in each task before the shuffle."""
    known = retrieved.where(F.col("evidence_type").isin(*EVIDENCE_ORDER))
    counts = known.groupBy("qid", "evidence_type").agg(F.count("*").alias("records"))
    placed = known.select("qid", "evidence_type", "_ord", *(c for c in pyramid_keys()))
    w = Window.partitionBy("qid", "evidence_type").orderBy("_quality", "_year", "_month", "_id", "_row")
    best = placed.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).select("qid", "evidence_type", "_ord", "_place")
    texts = nodes.select(F.col("_ord").alias("_node"), "citation", "main_findings")
    line = F.concat(F.lit("- **"), F.coalesce("citation", F.lit("")), F.lit("**："), F.coalesce("main_findings", F.lit("")))
    # k rows a question and type: at most six times k of a stated question set
    shown = texts.join(F.broadcast(best), F.col("_node") == F.col("_ord")).select("qid", "evidence_type", "_place", line.alias("_line"))
    lists = shown.groupBy("qid", "evidence_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_line"))), lambda x: x["_line"]).alias("lines"))
    return counts.join(lists, ["qid", "evidence_type"])


def markdown(questions: DataFrame, lead: DataFrame, relations: DataFrame, wording: Wording | None = None) -> DataFrame:
    """``qid`` and ``report``. ``questions`` has qid and text, ``relations`` qid and edges; a question without evidence has a report as well."""
    wd = wording or Wording()
    label = lookup(F.col("evidence_type"), dict(wd.labels), "")
    role = lookup(F.col("evidence_type"), dict(wd.roles), "") if wd.roles else F.lit("")
    rest = F.col("records") - F.size("lines")
    more = F.when(rest > 0, F.array(F.format_string(wd.more, rest))).otherwise(F.array().cast("array<string>"))
    rows = lead.select(
        "qid",
        F.struct(
            type_order(F.col("evidence_type")).alias("ord"),
            F.format_string("- **%s** %d", label, "records").alias("inventory"),
            F.array_join(F.concat(F.array(F.concat(F.lit("#### "), label)), F.col("lines"), more), "\n").alias("block"),
            F.format_string("| %s | %d | %s |", label, "records", role).alias("row"),
        ).alias("_t"),
    )
    by = rows.groupBy("qid").agg(F.array_sort(F.collect_list("_t")).alias("_all"))  # six types at most
    empty = F.array().cast(by.schema["_all"].dataType)
    joined = questions.join(by, "qid", "left").join(relations, "qid", "left").withColumn("_all", F.coalesce("_all", empty))

    def part(name: str) -> Column:
        return F.array_join(F.transform("_all", lambda t: t[name]), "\n")

    report = F.concat_ws(
        "\n\n",
        F.concat(F.lit(wd.title + "\n\n**"), F.coalesce("text", F.lit("")), F.lit("**")),
        F.concat(F.lit(wd.inventory + "\n\n"), part("inventory")),
        F.concat(F.lit(wd.records + "\n\n"), part("block")),
        F.concat(F.lit(wd.synthesis + "\n\n" + wd.table_head + "\n"), part("row")),
        F.format_string(wd.relations, F.coalesce("edges", F.lit(0))),
    )
    return joined.select("qid", report.alias("report"))


def payload(questions: DataFrame, lead: DataFrame) -> DataFrame:
    """``qid`` and one JSON object: the question, its leading evidence by type and the order of the types."""
    rows = lead.select("qid", F.struct(type_order(F.col("evidence_type")).alias("ord"), F.col("evidence_type").alias("type"), "records", "lines").alias("_t"))
    by = rows.groupBy("qid").agg(F.array_sort(F.collect_list("_t")).alias("_all"))
    kept = F.transform("_all", lambda t: F.struct(t["type"].alias("type"), t["records"].alias("records"), t["lines"].alias("lines")))
    order = F.array(*map(F.lit, EVIDENCE_ORDER))
    joined = questions.join(by, "qid", "left")
    whole = F.struct(F.col("text").alias("question"), F.coalesce(kept, F.array().cast("array<struct<type:string,records:bigint,lines:array<string>>>")).alias("ranked_evidence"), order.alias("pyramid_order"))
    return joined.select("qid", F.to_json(whole).alias("payload"))


def payload_rows(questions: DataFrame, placed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole payload of each question as rows ``qid``, ``part``, ``position`` and ``value``, a JSON text.

    Parts: ``question``; ``ranked_evidence``, a row per record with all its fields, nulls included, at its place in the
    pyramid; ``evidence_edges``, a row per induced edge, ordered by its row key; ``pyramid_order``, a row per type.
    ``placed`` has qid, _ord, id and place.
    """

    def as_json(*fields: str) -> Column:
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")

    # A record becomes JSON once and meets the questions that retrieve it in a join: nothing is shuffled after that.
    records = nodes.select(F.col("_ord").alias("_node"), as_json(*NODE_FIELDS))
    evidence = placed.select("qid", "_ord", "place").join(records, F.col("_ord") == F.col("_node")).select("qid", F.lit("ranked_evidence").alias("part"), F.col("place").alias("position"), "value")
    between = induced_each(edges.select("_ord", *EDGE_FIELDS), placed.select("qid", "id"), "qid")
    related = between.select("qid", F.lit("evidence_edges").alias("part"), F.col("_ord").alias("position"), as_json(*EDGE_FIELDS))
    asked = questions.select("qid", F.lit("question").alias("part"), F.lit(0).cast("bigint").alias("position"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("question"))).alias("value"))
    order = questions.select("qid", F.lit("pyramid_order").alias("part"), F.posexplode(F.array(*map(F.lit, EVIDENCE_ORDER))).alias("position", "_type"))
    order = order.select("qid", "part", F.col("position").cast("bigint").alias("position"), F.to_json(F.struct(F.col("_type").alias("type"))).alias("value"))
    return evidence.unionByName(related).unionByName(asked).unionByName(order)


def report_lines(questions: DataFrame, placed: DataFrame, nodes: DataFrame, edges: DataFrame, wording: Wording | None = None) -> DataFrame:
    """The whole report of each question as rows ``qid``, ``step_no``, ``step``, ``line_no``, ``node_id`` and ``line``.

    Lines of equal step and number are in the order of their text. A record's line has its place in the pyramid as number
    and its id; the inventory and the synthesis are about all the ids of the steps between them. Records of unknown types
    have a step of their own. The synthesis has a table row per type, the totals, and a line per relation: the known ones
    even without edges, then others by name, a null one as an empty name. ``placed`` as for ``payload_rows``, with evidence_type.
    """
    wd = wording or Wording()
    kind = lookup(F.col("evidence_type"), dict(wd.labels), wd.other)
    role = lookup(F.col("evidence_type"), dict(wd.roles), "") if wd.roles else F.lit("")
    last = len(EVIDENCE_ORDER)

    def rows(df: DataFrame, step: Column, no: Column, line: Column, node: Column | None = None) -> DataFrame:
        id_ = (F.lit(None) if node is None else node).cast("string")
        return df.select("qid", step.cast("int").alias("step_no"), F.get(F.array(*map(F.lit, STEPS)), step).alias("step"), no.cast("bigint").alias("line_no"), id_.alias("node_id"), line.alias("line"))

    known = F.when(F.col("evidence_type").isin(*EVIDENCE_ORDER), F.col("evidence_type"))
    counts = placed.groupBy("qid", known.alias("evidence_type")).agg(F.count("*").alias("records"))  # seven rows a question
    order = type_order(F.col("evidence_type"))
    texts = nodes.select(F.col("_ord").alias("_node"), F.concat(F.lit("- **"), F.coalesce("citation", F.lit("")), F.lit("**："), F.coalesce("main_findings", F.lit(""))).alias("_line"))
    listed = placed.join(texts, F.col("_ord") == F.col("_node"))
    between = induced_each(edges.select("source", "target", "relation"), placed.select("qid", "id"), "qid")
    related = between.groupBy("qid", F.coalesce("relation", F.lit("")).alias("relation")).agg(F.count("*").alias("edges"))
    standing = questions.select("qid", F.explode(F.array(*map(F.lit, RELATIONS))).alias("relation"), F.lit(0).cast("bigint").alias("edges"))
    related = related.unionByName(standing).groupBy("qid", "relation").agg(F.sum("edges").alias("edges"))
    found = counts.groupBy("qid").agg(F.sum("records").alias("_records"))
    totals = questions.join(related.groupBy("qid").agg(F.sum("edges").alias("_edges")), "qid").join(found, "qid", "left")
    parts = [
        rows(questions, F.lit(0), F.lit(0), F.coalesce("text", F.lit(""))),
        rows(counts, F.lit(1), order, F.format_string("- **%s** %d", kind, "records")),
        rows(listed, lookup(F.col("evidence_type"), STEP_OF, OTHER_STEP), F.col("place"), F.col("_line"), F.col("id")),
        rows(counts, F.lit(len(STEPS) - 1), order, F.format_string("| %s | %d | %s |", kind, "records", role)),
        rows(totals, F.lit(len(STEPS) - 1), F.lit(last + 1), F.format_string(wd.totals, F.coalesce("_records", F.lit(0)), "_edges")),
        rows(related, F.lit(len(STEPS) - 1), lookup(F.col("relation"), {r: last + 2 + i for i, r in enumerate(RELATIONS)}, last + 2 + len(RELATIONS)), F.format_string(wd.relation, "relation", "edges")),
    ]
    return reduce(DataFrame.unionByName, parts)
