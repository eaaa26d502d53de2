"""What a set of evidence says, as counts, flags and short texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import pyramid_keys, ranked, raw_of

# The types that count as high-level evidence, and the dose signals for a low dose.
HIGH_LEVEL = ["guideline", "systematic_review", "randomized_controlled_trial"]
LOW_DOSE = ["low_dose_preferred", "high_dose_not_preferred", "avoid_unnecessary_high_dose"]


def support(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: all records, high-level records in support, and whether one of those signals a low dose (false if there is none)."""
    high = F.col("evidence_type").isin(*HIGH_LEVEL) & F.startswith(F.coalesce("recommendation_direction", F.lit("")), F.lit("support"))
    return nodes.groupBy(*by).agg(
        F.count("*").alias("records"),
        F.coalesce(F.count_if(high), F.lit(0)).alias("in_support"),
        F.coalesce(F.bool_or(high & F.coalesce(F.col("dose_signal").isin(*LOW_DOSE), F.lit(False))), F.lit(False)).alias("low_dose"),
    )


def highlights(nodes: DataFrame, k: int = 3, separator: str = "；") -> DataFrame:
    """Per evidence type one text of its k highest records, ``citation：findings``, in pyramid order: a top-k report.

    The limit applies in each task before the shuffle, so a group holds k rows per task at most.
    """
    keys = pyramid_keys(raw_of(nodes))
    ranked = nodes.select("evidence_type", "citation", "main_findings", *keys)
    w = Window.partitionBy("evidence_type").orderBy("_quality", "_year", "_month", "_id", "_row")
    best = ranked.where(F.col("evidence_type").isNotNull()).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k)
    line = F.concat(F.coalesce("citation", F.lit("")), F.lit("："), F.coalesce("main_findings", F.lit("")))
    return best.groupBy("evidence_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", line.alias("_line")))), lambda x: x["_line"]), separator).alias("text"))


def type_summaries(nodes: DataFrame, chunk: int = 100, separator: str = "；") -> DataFrame:
    """All records of each evidence type, ``citation：findings``, in pyramid order, as numbered texts.

    ``chunk_no`` from 1 holds ``chunk`` records, the last of a type what is left, so no value and no task grows with a
    type; the chunks of a type, joined by the separator, are its summary. Unknown types and null have theirs as well.
    """
    named = F.coalesce(F.concat(F.lit("t"), "evidence_type"), F.lit("n"))  # a null type is told from every name
    keyed = nodes.select("_ord", "id", "evidence_type", "quality", "year", "month", named.alias("_named"))
    placed = ranked(keyed, pyramid_keys(), within=["_named"], name="_place").select("_ord", "evidence_type", "_place", F.ceil(F.col("_place") / chunk).cast("bigint").alias("chunk_no"))
    line = F.concat(F.coalesce("citation", F.lit("")), F.lit("："), F.coalesce("main_findings", F.lit("")))
    texts = nodes.select(F.col("_ord").alias("_node"), line.alias("_line"))
    lines = placed.join(texts, F.col("_ord") == F.col("_node"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_line"))), lambda x: x["_line"]), separator)
    return lines.groupBy("evidence_type", "chunk_no").agg(F.count("*").alias("records"), joined.alias("text"))
