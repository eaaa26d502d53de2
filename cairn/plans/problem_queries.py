"""The queries of the core's data-preparation operators, over their whole tables, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hotdeck import Category, Usable, fill_table, hot_deck
from ..operators.references import Reference, Validity, orphan_causes, orphan_references, orphan_report
from ..operators.shredding import leaf_rows, reconstruct, shred
from ..sources.tables import table

# ---------------------------------------------------------------- references

EDGE_REFERENCES = [Reference("source", ("source",), ("id",)), Reference("target", ("target",), ("id",))]
NODE_LIFE = Validity(at="loaded_at", start="loaded_at", end="deleted_at")


def _edge_orphans(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return orphan_references(table(spark, d, "evidence_edges"), table(spark, d, "evidence_nodes"), EDGE_REFERENCES, ["_ord"], keep, NODE_LIFE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _edge_orphans(spark, d).select(F.col("_ord").alias("edge_ord"), F.col("reference").alias("endpoint"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_edge_orphans(spark, d, ("loaded_at",)), "evidence_edges", "loaded_at").withColumnRenamed("reference", "endpoint")


def p2_causes(spark: SparkSession, d: str) -> DataFrame:
    """The report with the references told apart: to records that are missing, deleted or late."""
    orphans = orphan_causes(_edge_orphans(spark, d, ("loaded_at", "source", "target")), table(spark, d, "evidence_nodes"), EDGE_REFERENCES, NODE_LIFE)
    return orphan_report(orphans, "evidence_edges", "loaded_at", by=["cause"]).withColumnRenamed("reference", "endpoint")


COHORT_SITE = [Reference("cohort_site", ("cohort_id", "site_code"), ("cohort_id", "site_code"), match="partial")]


def p2_composite(spark: SparkSession, d: str) -> DataFrame:
    """Cases admitted from 2024 whose (cohort, site), as far as it isn't null, no earlier case had."""
    cases = table(spark, d, "patient_cases")
    old = F.col("admitted_at") < F.lit("2024-01-01").cast("timestamp_ntz")
    return orphan_references(cases.where(~old), cases.where(old), COHORT_SITE, ["case_ord"]).select("case_ord", "reference", "null_mask")


def p2_composite_all(spark: SparkSession, d: str) -> DataFrame:
    """All cases whose (cohort, site), as far as it isn't null, no case admitted earlier had.

    Cases of one time aren't earlier than each other. A case without a time is earlier than none and has none earlier.
    """
    cases = table(spark, d, "patient_cases").select("case_ord", "cohort_id", "site_code", "admitted_at")
    # An admission counts from the next microsecond on, and never ends.
    earlier = cases.select("cohort_id", "site_code", (F.col("admitted_at") + F.expr("INTERVAL '0.000001' SECOND")).alias("known_from"), F.lit(None).cast("timestamp_ntz").alias("known_to"))
    return orphan_references(cases, earlier, COHORT_SITE, ["case_ord"], validity=Validity(at="admitted_at", start="known_from", end="known_to")).select("case_ord", "reference", "null_mask")


_ORPHANS_SQL = """
WITH r AS (
  SELECT _ord, loaded_at, 'source' AS endpoint, source AS k FROM evidence_edges WHERE source IS NOT NULL
  UNION ALL SELECT _ord, loaded_at, 'target', target FROM evidence_edges WHERE target IS NOT NULL),
o AS (SELECT * FROM r WHERE NOT EXISTS (
  SELECT 1 FROM evidence_nodes n WHERE n.id = r.k AND n.loaded_at <= r.loaded_at AND (n.deleted_at IS NULL OR n.deleted_at > r.loaded_at)))
"""
P2_FOUND_SQL = _ORPHANS_SQL + "SELECT _ord AS edge_ord, endpoint FROM o"
P2_REPORT_SQL = _ORPHANS_SQL + "SELECT 'evidence_edges' AS table_name, endpoint, strftime(loaded_at, '%Y-%m') AS period, count(*) AS orphans FROM o GROUP BY ALL"
P2_CAUSES_SQL = _ORPHANS_SQL + """, f AS (SELECT id, min(loaded_at) AS first FROM evidence_nodes WHERE id IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1)
SELECT 'evidence_edges' AS table_name, endpoint, strftime(loaded_at, '%Y-%m') AS period,
  CASE WHEN first IS NULL THEN 'missing' WHEN loaded_at IS NULL THEN 'untimed' WHEN first > loaded_at THEN 'late' ELSE 'deleted' END AS cause, count(*) AS orphans
FROM o LEFT JOIN f ON f.id = o.k GROUP BY ALL"""
P2_COMPOSITE_SQL = """
WITH c AS (SELECT * FROM patient_cases WHERE admitted_at >= TIMESTAMP '2024-01-01'),
     p AS (SELECT DISTINCT cohort_id, site_code FROM patient_cases WHERE admitted_at < TIMESTAMP '2024-01-01')
SELECT case_ord, 'cohort_site' AS reference,
       CASE WHEN cohort_id IS NULL THEN '1' ELSE '0' END || CASE WHEN site_code IS NULL THEN '1' ELSE '0' END AS null_mask
FROM c WHERE (cohort_id IS NOT NULL OR site_code IS NOT NULL) AND NOT EXISTS (
  SELECT 1 FROM p WHERE (c.cohort_id IS NULL OR p.cohort_id = c.cohort_id) AND (c.site_code IS NULL OR p.site_code = c.site_code))
"""
P2_COMPOSITE_ALL_SQL = """
WITH p AS (SELECT cohort_id, site_code, min(admitted_at) AS since FROM patient_cases GROUP BY ALL)
SELECT case_ord, 'cohort_site' AS reference,
       CASE WHEN cohort_id IS NULL THEN '1' ELSE '0' END || CASE WHEN site_code IS NULL THEN '1' ELSE '0' END AS null_mask
FROM patient_cases c WHERE (cohort_id IS NOT NULL OR site_code IS NOT NULL) AND NOT EXISTS (
  SELECT 1 FROM p WHERE since < c.admitted_at AND (c.cohort_id IS NULL OR p.cohort_id = c.cohort_id) AND (c.site_code IS NULL OR p.site_code = c.site_code))
"""

# ---------------------------------------------------------------- nested records

SECTION_LEAF = {"symptoms": "fever_days", "labs": "crp_mg_l", "pathogen": "mycoplasma_pcr", "imaging": "image_path"}
# The flat tables: repeated ancestor, its leaves, and the positions that link a row to its parents.
FLAT_TABLES = {
    "cases": ("", ["case_id", "age_years", "sex"], ["case_no"]),
    "symptoms": ("symptoms", ["fever_days", "max_temperature_c", "cough", "dyspnea"], ["case_no", "item_no"]),
    "labs": ("labs", ["wbc_10e9_l", "crp_mg_l", "pct_ng_ml", "ldh_u_l"], ["case_no", "item_no"]),
    "pathogen": ("pathogen", ["mycoplasma_pcr", "mycoplasma_igm", "macrolide_resistance"], ["case_no", "item_no"]),
    "imaging": ("imaging", ["image_path", "radiology_report"], ["case_no", "item_no"]),
    "doses": ("treatment_history.courses.doses", ["mg", "day"], ["case_no", "history_no", "course_no", "dose_no"]),
}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    levels = shred(table(spark, d, "case_records"), "raw_id", "payload", [f"{s}.{x}" for s, x in SECTION_LEAF.items()])
    return leaf_rows(levels, "raw_id", SECTION_LEAF, ["case_no", "item_no"])


def flat_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    prefix, leaves, ordinals = FLAT_TABLES[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        levels = shred(table(spark, d, "case_records"), "raw_id", "payload", [f"{prefix}.{x}".lstrip(".") for x in leaves])
        return reconstruct(levels, "raw_id", prefix, leaves, ordinals).select("raw_id", *ordinals, *leaves)

    return query


CASES_SQL = """
WITH doc AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM case_records),
u AS (SELECT raw_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM doc),
l AS (SELECT raw_id, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j -> 'cases') = 'ARRAY' THEN j -> 'cases'
  WHEN json_type(j -> 'case') = 'OBJECT' THEN json_array(j -> 'case') WHEN json_type(j) = 'OBJECT' THEN json_array(j) END AS a FROM u),
c AS (SELECT raw_id, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS case_no, a FROM l WHERE a IS NOT NULL),
k AS (SELECT raw_id, case_no, json_extract(a, '$[' || case_no || ']') AS o FROM c),
cs AS (SELECT * FROM k WHERE json_type(o) = 'OBJECT'),
"""


def _section_sql(section: str) -> str:
    return f"""{section}_l AS (SELECT raw_id, case_no, CASE WHEN json_type(o -> '{section}') = 'ARRAY' THEN o -> '{section}' ELSE json_array(o -> '{section}') END AS a FROM cs),
{section}_n AS (SELECT raw_id, case_no, a, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS item_no FROM {section}_l),
{section}_i AS (SELECT raw_id, case_no, item_no, json_extract(a, '$[' || item_no || ']') AS o FROM {section}_n),
"""


P4_FOUND_SQL = (
    CASES_SQL
    + "".join(map(_section_sql, SECTION_LEAF))
    + "f AS ("
    + " UNION ALL ".join(f"SELECT raw_id, case_no, '{s}' AS section_name, item_no, o ->> '{leaf}' AS v FROM {s}_i WHERE json_type(o) = 'OBJECT'" for s, leaf in SECTION_LEAF.items())
    + ") SELECT raw_id, case_no, section_name, item_no FROM f WHERE v IS NOT NULL AND v <> ''"
)


def _leaf_sql(leaf: str) -> str:
    """A leaf as text; numbers without trailing zeros."""
    plain = f"regexp_replace(regexp_replace(o ->> '{leaf}', '(\\.[0-9]*[1-9])0+$', '\\1'), '\\.0*$', '')"
    return f"CASE WHEN json_type(o -> '{leaf}') = 'DOUBLE' THEN {plain} ELSE o ->> '{leaf}' END AS {leaf}"


def _flat_sql(name: str) -> str:
    prefix, leaves, ordinals = FLAT_TABLES[name]
    source = f"{prefix}_i" if prefix else "cs"
    return CASES_SQL + (_section_sql(prefix) if prefix else "") + f"z AS (SELECT 1) SELECT raw_id, {', '.join(ordinals)}, {', '.join(_leaf_sql(x) for x in leaves)} FROM {source} WHERE json_type(o) = 'OBJECT'"


# ---------------------------------------------------------------- missing values

FILLED_FIELDS = {
    "pct_ng_ml": Usable("labs.pct_ng_ml", 0, 500, low_open=True),
    "ldh_u_l": Usable("labs.ldh_u_l", 20, 8000),
    "spo2": Usable("vitals.spo2", 40, 100),
}


def _fills(spark: SparkSession, d: str) -> DataFrame:
    return hot_deck(table(spark, d, "patient_cases"), "case_ord", "cohort_id", "case_id", FILLED_FIELDS, ["admitted_at"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _fills(spark, d).select("case_ord", "field_name")


def p5_donors(spark: SparkSession, d: str) -> DataFrame:
    return _fills(spark, d)


# An unknown resistance, no response and an empty text aren't values.
CATEGORY_FIELDS = {
    "sex": Category("sex", ("female", "male")),
    "macrolide_resistance": Category("pathogen.macrolide_resistance", ("resistant", "sensitive")),
    "response": Category("treatment_history.response", ("good", "partial", "poor")),
}


def p5_categorical(spark: SparkSession, d: str) -> DataFrame:
    return hot_deck(table(spark, d, "patient_cases"), "case_ord", "cohort_id", "case_id", CATEGORY_FIELDS, ["admitted_at"])


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_table(table(spark, d, "patient_cases"), _fills(spark, d), "case_ord", FILLED_FIELDS, ["cohort_id"])


_USABLE_SQL = """
WITH v AS (
  SELECT case_ord, cohort_id, case_id, admitted_at, 'pct_ng_ml' AS field_name, CASE WHEN labs.pct_ng_ml > 0 AND labs.pct_ng_ml <= 500 THEN labs.pct_ng_ml END AS v FROM patient_cases
  UNION ALL SELECT case_ord, cohort_id, case_id, admitted_at, 'ldh_u_l', CASE WHEN labs.ldh_u_l BETWEEN 20 AND 8000 THEN labs.ldh_u_l END FROM patient_cases
  UNION ALL SELECT case_ord, cohort_id, case_id, admitted_at, 'spo2', CASE WHEN vitals.spo2 BETWEEN 40 AND 100 THEN vitals.spo2 END FROM patient_cases)
"""
P5_FOUND_SQL = _USABLE_SQL + """
, g AS (SELECT cohort_id, field_name, min(case_id) AS a, max(case_id) AS b FROM v WHERE v IS NOT NULL GROUP BY ALL)
SELECT v.case_ord, v.field_name FROM v JOIN g USING (cohort_id, field_name) WHERE v.v IS NULL AND (g.a <> v.case_id OR g.b <> v.case_id)
"""
_CATEGORIES_SQL = "WITH v AS (" + " UNION ALL ".join(
    f"SELECT case_ord, cohort_id, case_id, admitted_at, '{f}' AS field_name, CASE WHEN lower(trim({c.path})) IN ({', '.join(repr(x) for x in c.values)}) THEN lower(trim({c.path})) END AS v FROM patient_cases" for f, c in CATEGORY_FIELDS.items()
) + ")"
_NEAREST_SQL = """
, n AS (SELECT *, row_number() OVER (PARTITION BY cohort_id, field_name ORDER BY admitted_at NULLS FIRST, case_ord) AS pos FROM v WHERE cohort_id IS NOT NULL)
, c AS (SELECT r.case_ord, r.field_name, d.v AS filled, d.case_ord AS donor, CASE WHEN d.pos < r.pos THEN 'previous' ELSE 'next' END AS side,
    abs(epoch_us(r.admitted_at) / 1e6::DOUBLE - epoch_us(d.admitted_at) / 1e6::DOUBLE) AS distance, abs(d.pos - r.pos) AS steps
  FROM n r JOIN n d ON r.cohort_id = d.cohort_id AND r.field_name = d.field_name AND d.case_id <> r.case_id WHERE r.v IS NULL AND d.v IS NOT NULL)
SELECT case_ord, field_name, filled, donor, side, distance FROM c
QUALIFY row_number() OVER (PARTITION BY case_ord, field_name ORDER BY distance NULLS LAST, CASE side WHEN 'previous' THEN 0 ELSE 1 END, steps) = 1
"""

P5_DONORS_SQL = _USABLE_SQL + _NEAREST_SQL
P5_CATEGORICAL_SQL = _CATEGORIES_SQL + _NEAREST_SQL
P5_FILLED_SQL = f"""WITH f AS ({P5_DONORS_SQL})
SELECT c.case_ord, c.cohort_id, {', '.join(f"coalesce(max(v.v) FILTER (v.field_name = '{x}'), max(f.filled) FILTER (f.field_name = '{x}')) AS {x}, max(v.v) FILTER (v.field_name = '{x}') IS NULL AND max(f.filled) FILTER (f.field_name = '{x}') IS NOT NULL AS {x}_filled" for x in FILLED_FIELDS)}
FROM patient_cases c JOIN (SELECT * FROM ({_USABLE_SQL} SELECT * FROM v)) v ON v.case_ord = c.case_ord LEFT JOIN f ON f.case_ord = c.case_ord GROUP BY ALL"""
_LIST_SQL = "CASE WHEN json_type({x}) = 'ARRAY' THEN {x} ELSE json_array({x}) END"
P4_DOSES_SQL = CASES_SQL + "".join(
    f"""d{i}_l AS (SELECT * EXCLUDE (o), {_LIST_SQL.format(x=f"(o -> '{name}')")} AS a FROM {source}),
d{i}_n AS (SELECT *, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS {no} FROM d{i}_l),
d{i} AS (SELECT * FROM (SELECT * EXCLUDE (a), json_extract(a, '$[' || {no} || ']') AS o FROM d{i}_n) WHERE json_type(o) = 'OBJECT'),
"""
    for i, (name, no, source) in enumerate([("treatment_history", "history_no", "cs"), ("courses", "course_no", "d0"), ("doses", "dose_no", "d1")])
) + f"z AS (SELECT 1) SELECT raw_id, case_no, history_no, course_no, dose_no, {_leaf_sql('mg')}, {_leaf_sql('day')} FROM d2"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_causes": p2_causes,
    "p2_composite": p2_composite,
    "p2_composite_all": p2_composite_all,
    "p4_found": p4_found,
    **{f"p4_{name}": flat_table(name) for name in FLAT_TABLES},
    "p5_found": p5_found,
    "p5_donors": p5_donors,
    "p5_filled": p5_filled,
    "p5_categorical": p5_categorical,
}
SQL = {
    "p2_found": P2_FOUND_SQL,
    "p2_report": P2_REPORT_SQL,
    "p2_causes": P2_CAUSES_SQL,
    "p2_composite": P2_COMPOSITE_SQL, "p2_composite_all": P2_COMPOSITE_ALL_SQL,
    "p4_found": P4_FOUND_SQL,
    **{f"p4_{name}": _flat_sql(name) for name in FLAT_TABLES if name != "doses"},
    "p5_found": P5_FOUND_SQL,
    "p5_donors": P5_DONORS_SQL,
    "p5_filled": P5_FILLED_SQL,
    "p5_categorical": P5_CATEGORICAL_SQL,
    "p4_doses": P4_DOSES_SQL,
}
