"""Queries of the operators for training text, over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formatting_duplicates import collapsed, copies
from .leakage import leaked_items, without_leaks
from .packing import containers, mixture, pack_documents
from .subjects import held_out, subject_areas
from .term_counts import term_counts


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- duplicates hidden by formatting


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(_table(spark, d, "evidence_nodes"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(_table(spark, d, "evidence_nodes"))


def _canonical_sql(x: str) -> str:
    words = f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({words}, '([^\\p{{Nd}}]) ', '\\1', 'g'), ' ([^\\p{{Nd}}])', '\\1', 'g')"


_COPIES_SQL = f"""
WITH c AS (SELECT _ord, {_canonical_sql("title")} AS t,
  list_sort(list_filter(list_transform(string_split_regex(citation, '[;|；]'), lambda x: {_canonical_sql("x")}), lambda x: x <> '')) AS f FROM evidence_nodes),
k AS (SELECT _ord, CASE WHEN t <> '' AND len(f) > 0 THEN t END AS t, CASE WHEN t <> '' AND len(f) > 0 THEN f END AS f FROM c),
g AS (SELECT _ord, t, min(_ord) OVER (PARTITION BY t, f) AS kept FROM k)
"""
P1_FOUND_SQL = _COPIES_SQL + "SELECT kept AS kept_ord, _ord AS copy_ord FROM g WHERE t IS NOT NULL AND kept <> _ord"
P1_RECORDS_SQL = _COPIES_SQL + "SELECT CASE WHEN t IS NULL THEN _ord ELSE kept END AS kept_ord, count(*) AS copies FROM g GROUP BY 1"

# ---------------------------------------------------------------- frequency of terms


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = term_counts([(_table(spark, d, "evidence_nodes"), "tags"), (_table(spark, d, "knowledge_base"), "tags")])
    return counts.select("term", "occurrences", "records", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).select("term", "mark").where(F.col("mark").isNotNull())


_BLANKS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
P3_TERMS_SQL = f"""
WITH r AS (SELECT row_number() OVER () AS rid, tags FROM (SELECT tags FROM evidence_nodes UNION ALL SELECT tags FROM knowledge_base)),
e AS (SELECT rid, unnest(tags) AS tag FROM r),
t AS (SELECT rid, lower(regexp_replace(tag, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')) AS term FROM e WHERE tag IS NOT NULL),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT rid) AS records FROM t WHERE term <> '' GROUP BY term)
SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > (SELECT count(*) FROM r) / 20.0 THEN 'common' END AS mark FROM c
"""
P3_FOUND_SQL = f"SELECT term, mark FROM ({P3_TERMS_SQL}) WHERE mark IS NOT NULL"

# ---------------------------------------------------------------- packing


def p6_assigned(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_table(spark, d, "documents"), _table(spark, d, "pack_capacity"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, tokens in them and the share of unused space."""
    packs = _table(spark, d, "pack_capacity")
    by = containers(p6_assigned(spark, d), packs).groupBy("pack_name")
    return by.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (F.sum("unused") / (F.sum("tokens") + F.sum("unused"))).alias("unused_share"))


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How far each 100 containers in a row are from the mixture of all."""
    return mixture(p6_assigned(spark, d))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: the documents assigned, the containers that hold too much, and the documents split although they fit."""
    parts, packs = p6_assigned(spark, d), _table(spark, d, "pack_capacity")
    over = containers(parts, packs).groupBy("pack_name").agg(F.count_if(F.col("unused") < 0).alias("overfull"))
    whole = parts.groupBy("pack_name", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"))
    needed = F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")), F.lit(1))
    kept = whole.join(packs, "pack_name").groupBy("pack_name").agg(F.count("*").alias("documents"), F.count_if(F.col("parts") != needed).alias("wrongly_split"))
    return kept.join(over, "pack_name").select("pack_name", "documents", "overfull", "wrongly_split")


P6_KEPT_SQL = "SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS overfull, 0 AS wrongly_split FROM pack_capacity"

# ---------------------------------------------------------------- leaked evaluation items


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the corpus."""
    return without_leaks(_table(spark, d, "documents"), p7_leaks(spark, d)).select("doc_id", "page_id", "source", "lang")


# ---------------------------------------------------------------- subject areas


PAGE_METADATA = ("page_title", "ns_code")  # these tables have no addresses


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(_table(spark, d, "documents"), _table(spark, d, "subject_examples"), about=PAGE_METADATA)


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject."""
    return p8_found(spark, d).groupBy("subject").agg(F.count("*").alias("pages"))


def p8_held_out(spark: SparkSession, d: str) -> DataFrame:
    """How excerpts that the fit didn't see are classified."""
    return held_out(_table(spark, d, "documents"), _table(spark, d, "subject_examples"), about=PAGE_METADATA)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p6_assigned": p6_assigned,
    "p6_fill": p6_fill,
    "p6_mixture": p6_mixture,
    "p6_kept": p6_kept,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_clean": p7_clean,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
    "p8_held_out": p8_held_out,
}
SQL: dict[str, str] = {"p1_found": P1_FOUND_SQL, "p1_records": P1_RECORDS_SQL, "p3_found": P3_FOUND_SQL, "p3_terms": P3_TERMS_SQL, "p6_kept": P6_KEPT_SQL}
