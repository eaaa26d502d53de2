"""Queries of the evidence and case operators over their whole tables, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ASCII_TOKEN, IMAGING_PHRASES, affirmed, mixed_tokens, token_set, wrapped_title
from ..operators.cases import EXPECTED, SECTIONS, exploded_cases, normalized, structured
from ..operators.graph import RELATIONS, REQUIRED, dangling, duplicate_ids, edges_by_relation, graph_counts, induced, induced_each, neighbours, relation_counts, violations
from ..operators.ranking import EVIDENCE_LABELS, EVIDENCE_ORDER, QUALITY_ORDER, MISSING_QUALITY, first_in_pyramid, lane_positions, pyramid, type_inventory
from ..operators.bulk_retrieval import retrieved_places
from ..operators.retrieval import FLOOR_TOPICS, NODE_FIELDS, NOTHING_FOUND, Question, knowledge_for_case, knowledge_text, knowledge_top, of_types, pyramid_order, question_table, result_questions, retrieval_order, retrieve, title_questions
from ..operators.report import EDGE_FIELDS, STEPS, STEP_OF, leading, markdown, payload, payload_rows, report_lines
from ..operators.rules import Rule, apply_rules, at_least, below
from ..operators.summary import HIGH_LEVEL, LOW_DOSE, highlights, support, type_summaries
from ..sources.json_documents import NODE, records_of
from ..sources.tables import table
from .problem_queries import CASES_SQL
from .workflow import latest, step_violations, trace

# The stated query set: CJK with ASCII, nothing, only punctuation, no match, a JSON key, repeats, type filters.
QUESTIONS = [
    Question(1, "重症支原体肺炎 SMPP 儿童"),
    Question(2, "", ("guideline",)),
    Question(3, "?!", ()),
    Question(4, "qqzzxxyy", ("randomized_controlled_trial", "case_report")),
    Question(5, "year of the guideline"),
    Question(6, "steroid steroid dose in children", ("systematic_review",)),
    Question(7, "pleural effusion refractory pneumonia macrolide 2024"),
]
NODE_OF_INTEREST = "GUIDE-2022-HUBQA-0000000"


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "evidence_nodes")


def _keyed(s: SparkSession, d: str) -> DataFrame:
    """What the evidence order depends on; a rank writes all columns that it is given."""
    return _nodes(s, d).select("_ord", "id", "evidence_type", "quality", "year", "month")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "evidence_edges")


def _kb(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "knowledge_base")


# ---------------------------------------------------------------- SQL parts


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _case(column: str, values: dict, default: object) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def _quality_sql(column: str) -> str:
    """A missing quality counts as low."""
    return f"CASE WHEN {column} IS NULL THEN {MISSING_QUALITY} ELSE {_case(column, QUALITY_ORDER, 9)} END"


_PYRAMID = f"{_case('evidence_type', EVIDENCE_ORDER, 6)}, {_quality_sql('quality')}, coalesce(year, 0) DESC, coalesce(month, 0) DESC, coalesce(id, ''), _ord"
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({q.qid}::BIGINT, {_quoted(q.text)}, {'NULL::VARCHAR[]' if q.types is None else '[' + ', '.join(map(_quoted, q.types)) + ']::VARCHAR[]'})" for q in QUESTIONS) + ") AS v(qid, text, types))"
_RETRIEVED = f"""WITH {_Q},
k AS (SELECT qid, types, list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+'), lambda t: lower(t)) AS toks FROM q),
h AS (SELECT *, lower(CAST(json_merge_patch('{{}}'::JSON, to_json(struct_pack({', '.join(f'{c} := {c}' for c in NODE_FIELDS)}))) AS VARCHAR)) AS hay FROM evidence_nodes),
s AS (SELECT qid, types, h._ord, id, evidence_type, quality, year, month, len(list_filter(toks, lambda t: contains(hay, t))) AS score FROM k, h),
r AS (SELECT * FROM s QUALIFY score > 0 OR max(score) OVER (PARTITION BY qid) = 0)
"""
_KB_WORDS = "list_distinct(regexp_extract_all(lower(concat_ws(' ', {parts})), '[a-zA-Z0-9_]+'))"
_KB_PARTS = "coalesce(topic, ''), coalesce(array_to_string(list_filter(tags, lambda x: x IS NOT NULL), ' '), ''), coalesce(statement, ''), coalesce(clinical_use, '')"

_TITLES = "q AS (SELECT _ord AS qid, coalesce(title, '') AS text, NULL::VARCHAR[] AS types FROM evidence_nodes WHERE _ord % 50 = 0)"


def _top_sql(parts: str, floor: bool) -> str:
    words = _KB_WORDS.format(parts=parts)
    shared = f"len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')), {words}))"
    score = f"CASE WHEN {shared} = 0 AND topic IN ({', '.join(map(_quoted, FLOOR_TOPICS))}) THEN 1 ELSE {shared} END" if floor else shared
    return f"""WITH {_Q}, s AS (SELECT qid, _ord, id, topic, statement, clinical_use, CAST({score} AS BIGINT) AS score FROM q, knowledge_base),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, _ord) AS place FROM s WHERE score > 0 QUALIFY place <= 5)
"""


def _affirmed_sql(report: str, phrases: list[str]) -> str:
    low = f"lower(coalesce({report}, ''))"
    return "(" + " OR ".join(f"(contains({low}, {_quoted(p)}) AND NOT regexp_matches({low}, '\\b(?:no|without|absent|negative for)\\b[^.]*\\b{p}\\b'))" for p in phrases) + ")"


# ---------------------------------------------------------------- rules as parameters

INFLAMMATION_CUTS = [(4.0, "many"), (2.0, "some")]


def _inflammation() -> list[Rule]:
    return [
        Rule(at_least(F.col("labs_crp_mg_l"), 40), 1, "crp"),
        Rule(at_least(F.col("labs_pct_ng_ml"), 0.5), 1.5, "pct"),
        Rule(at_least(F.col("labs_ldh_u_l"), 350), 1, "ldh"),
        Rule(below(F.col("vitals_spo2"), 95), 2, "spo2"),
        Rule(F.col("imaging_pleural_effusion") | F.col("imaging_multilobar"), 0.5, "imaging"),
        Rule(F.col("pathogen_mycoplasma_pcr").isin("positive", "+", "detected"), 0.5, "pcr"),
    ]


def _rules_sql() -> str:
    def num(c: str, at: float) -> str:
        return f"coalesce(NOT isnan({c}) AND {c} >= {at}, false)"

    imaging = " OR ".join(f"coalesce(imaging.image_features.{f}, false) OR {_affirmed_sql('imaging.radiology_report', IMAGING_PHRASES[f])}" for f in ("pleural_effusion", "multilobar"))
    holds = [
        (num("labs.crp_mg_l", 40), 1.0, "crp"), (num("labs.pct_ng_ml", 0.5), 1.5, "pct"), (num("labs.ldh_u_l", 350), 1.0, "ldh"),
        ("coalesce(vitals.spo2 < 95, false)", 2.0, "spo2"), (f"({imaging})", 0.5, "imaging"), ("coalesce(lower(pathogen.mycoplasma_pcr), '') IN ('positive', '+', 'detected')", 0.5, "pcr"),
    ]
    score = " + ".join(f"CASE WHEN {h} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for h, w, _ in holds)
    reasons = "concat_ws(',', " + ", ".join(f"CASE WHEN {h} THEN '{n}' END" for h, _, n in holds) + ")"
    return f"SELECT case_ord, least(s, 6.0::DOUBLE) AS rule_score, CASE WHEN s >= 4 THEN 'many' WHEN s >= 2 THEN 'some' ELSE 'few' END AS rule_level, rule_reasons FROM (SELECT case_ord, {score} AS s, {reasons} AS rule_reasons FROM patient_cases)"


# ---------------------------------------------------------------- workflows

TOOLS = list(range(10))


def _plan_faults(s: SparkSession, d: str) -> DataFrame:
    """Every order as a plan, its lines as steps."""
    lines = table(s, d, "lineitem")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")  # a handful of lines an order
    kind = F.when(F.col("l_returnflag") == "A", "quantitative").when(F.col("l_returnflag") == "N", "qualitative").otherwise(F.col("l_returnflag"))
    steps = lines.select(F.col("l_orderkey").alias("plan"), F.row_number().over(place).cast("bigint").alias("position"), F.col("l_linenumber").cast("bigint").alias("id"), kind.alias("action_type"),
                         F.array(F.col("l_suppkey") % 12, F.col("l_partkey") % 11).alias("tools"), F.array((F.col("l_linenumber") - 1).cast("bigint"), F.col("l_partkey") % 5).alias("inputs"))
    return step_violations(steps, TOOLS)


def _json_nodes(s: SparkSession, d: str) -> DataFrame:
    """Records as JSON, as from a source: rows of odd keys with their nulls, the others without the keys that have none."""
    texts = _nodes(s, d).select("_ord", F.when(F.col("_ord") % 2 == 1, F.to_json(F.struct(*NODE_FIELDS), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(*NODE_FIELDS))).alias("_text"))
    return records_of(texts, "_ord", "_text", NODE)


def _trace(s: SparkSession, d: str) -> DataFrame:
    """All records that edges point to, with what the records of these ids say."""
    used = _edges(s, d).select(F.col("target").alias("evidence_id"))
    return trace(used, _nodes(s, d).select("id", "_ord", F.col("evidence_type").alias("topic"), F.col("main_findings").alias("statement")))


def _case_evidence(s: SparkSession, d: str) -> DataFrame:
    """What the findings of each case retrieve: its scores and its pathogen and treatment words are the question."""
    flat = apply_rules(structured(table(s, d, "patient_cases"), "case_ord"), _inflammation(), INFLAMMATION_CUTS, "few", "rule", cap=6.0)
    found = flat.select("case_ord", F.struct("rule_level", "rule_reasons").alias("severity"), F.struct(F.col("pathogen_mycoplasma_pcr").alias("mycoplasma"), F.col("treatment_history_response").alias("treatment")).alias("case"))
    return knowledge_for_case(_kb(s, d), result_questions(found, "case_ord", ["severity", "case"])).select("qid", "id", "score", "place")


def _cases(s: SparkSession, d: str, first_only: bool) -> DataFrame:
    flat = normalized(exploded_cases(table(s, d, "case_records"), "raw_id", "payload"), first_only=first_only)
    return flat.select("raw_id", "case_no", "case_id", "age_years", "symptoms_fever_days", "symptoms_cough", "labs_crp_mg_l", "pathogen_mycoplasma_pcr", "treatment_history_response", F.array_join("modalities", ",").alias("modalities"), F.array_join("missing_sections", ",").alias("missing_sections"))


def _findings(s: SparkSession, d: str) -> DataFrame:
    flags = structured(table(s, d, "patient_cases"), "case_ord")
    return flags.select("case_ord", *(f"imaging_{f}" for f in IMAGING_PHRASES))


def _report_findings(s: SparkSession, d: str) -> DataFrame:
    report = F.col("imaging.radiology_report")
    return table(s, d, "patient_cases").select("case_ord", *(affirmed(report, p).alias(f) for f, p in IMAGING_PHRASES.items()))


def _scores(s: SparkSession, d: str) -> DataFrame:
    scored = apply_rules(structured(table(s, d, "patient_cases"), "case_ord"), _inflammation(), INFLAMMATION_CUTS, "few", "rule", cap=6.0)
    return scored.select("case_ord", "rule_score", "rule_level", F.array_join("rule_reasons", ",").alias("rule_reasons"))


def _latest_cases(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "patient_cases").select("case_id", "case_ord", "loaded_at", "age_years"), ["case_id"], ["loaded_at", "case_ord"]).select("case_id", "case_ord", "age_years")


def _subgraph(s: SparkSession, d: str) -> DataFrame:
    picked = of_types(retrieve(_nodes(s, d), QUESTIONS)).select("qid", "id")
    return induced_each(_edges(s, d).select("_ord", "source", "target", "relation"), picked, "qid").select("qid", "_ord", "relation")


def _leading(s: SparkSession, d: str) -> DataFrame:
    return leading(of_types(retrieve(_nodes(s, d), QUESTIONS)), _nodes(s, d), 3)


def _reports(s: SparkSession, d: str) -> DataFrame:
    edges = _subgraph(s, d).groupBy("qid").agg(F.count("*").alias("edges"))
    return markdown(question_table(s, QUESTIONS), _leading(s, d), edges)


def _payloads(s: SparkSession, d: str) -> DataFrame:
    return payload(question_table(s, QUESTIONS), _leading(s, d))


def _placed(s: SparkSession, d: str) -> DataFrame:
    """All that the questions retrieve, in pyramid order: what the order and the edges depend on only."""
    found = of_types(retrieve(_nodes(s, d), QUESTIONS))
    return pyramid_order(found.select("qid", "_ord", "id", "evidence_type", "quality", "year", "month")).select("qid", "_ord", "id", "evidence_type", "place")


def _payload_rows(s: SparkSession, d: str) -> DataFrame:
    return payload_rows(question_table(s, QUESTIONS), _placed(s, d), _nodes(s, d), _edges(s, d))


def _report_lines(s: SparkSession, d: str) -> DataFrame:
    return report_lines(question_table(s, QUESTIONS), _placed(s, d), _nodes(s, d), _edges(s, d))


def _guideline_edges(s: SparkSession, d: str) -> DataFrame:
    high = _nodes(s, d).where(F.col("evidence_type").isin(*HIGH_LEVEL))
    return induced(_edges(s, d), high).groupBy("relation").agg(F.count("*").alias("edges"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q_tokens": lambda s, d: _nodes(s, d).select("_ord", F.array_join(mixed_tokens(F.col("title")), "|").alias("mixed"), F.array_join(F.array_sort(token_set(F.col("title"))), "|").alias("words")),
    "q_token_counts": lambda s, d: _nodes(s, d).select("_ord", F.coalesce(F.size(mixed_tokens(F.col("title"))), F.lit(0)).cast("bigint").alias("mixed"), F.size(token_set(F.col("title"))).cast("bigint").alias("words")),
    "q_retrieve": lambda s, d: retrieval_order(retrieve(_nodes(s, d), QUESTIONS)).select("qid", "_ord", "score", "place"),
    "q_retrieve_by_type": lambda s, d: pyramid_order(of_types(retrieve(_nodes(s, d), QUESTIONS))).select("qid", "_ord", "place"),
    "q_pyramid_rank": lambda s, d: pyramid(_keyed(s, d)).select("_ord", "pyramid_rank"),
    "q_type_inventory": lambda s, d: type_inventory(_nodes(s, d)),
    "q_lane_positions": lambda s, d: lane_positions(_keyed(s, d)).select("_ord", "lane", "row_index"),
    "q_relation_counts": lambda s, d: relation_counts(_edges(s, d)),
    "q_edges_by_relation": lambda s, d: edges_by_relation(_edges(s, d).select("_ord", "relation")).select("_ord", "relation", "position"),
    "q_induced_subgraph": _subgraph,
    "q_high_level_relations": _guideline_edges,
    "q_dangling_edges": lambda s, d: dangling(_edges(s, d), _nodes(s, d)),
    "q_duplicate_ids": lambda s, d: duplicate_ids(_nodes(s, d)),
    "q_graph_violations": lambda s, d: violations(_nodes(s, d), _edges(s, d)).groupBy("check", "detail").agg(F.count("*").alias("n")),
    "q_graph_health": lambda s, d: graph_counts(_nodes(s, d), _edges(s, d)),
    "q_neighbours": lambda s, d: neighbours(_edges(s, d), NODE_OF_INTEREST),
    "q_knowledge_top": lambda s, d: knowledge_top(_kb(s, d), QUESTIONS).select("qid", "id", "score", "place"),
    "q_knowledge_for_case": lambda s, d: knowledge_for_case(_kb(s, d), QUESTIONS).select("qid", "id", "score", "place"),
    "q_title_retrieve": lambda s, d: retrieved_places(_nodes(s, d), title_questions(_nodes(s, d))),
    "q_title_knowledge_top": lambda s, d: knowledge_top(_kb(s, d), title_questions(_nodes(s, d))).select("qid", "id", "score", "place"),
    "q_title_knowledge_for_case": lambda s, d: knowledge_for_case(_kb(s, d), title_questions(_nodes(s, d))).select("qid", "id", "score", "place"),
    "q_knowledge_text": lambda s, d: knowledge_text(knowledge_top(_kb(s, d), QUESTIONS), QUESTIONS),
    "q_support": lambda s, d: support(_nodes(s, d), ["year"]),
    "q_top3_highlights": lambda s, d: highlights(_nodes(s, d)),
    "q_highlights": lambda s, d: type_summaries(_nodes(s, d)),
    "q_top3_evidence": lambda s, d: _leading(s, d).select("qid", "evidence_type", "records", F.array_join("lines", "\n").alias("lines")),
    "q_top3_reports": _reports,
    "q_reports": _report_lines,
    "q_top3_payloads": _payloads,
    "q_payloads": _payload_rows,
    "q_first_record": lambda s, d: first_in_pyramid(_nodes(s, d), ["systematic_review", "case_report"]).select("_ord", "id"),
    "q_title_wrap": lambda s, d: _nodes(s, d).select("_ord", F.array_join(wrapped_title(F.col("title")), "|").alias("wrapped")),
    "q_normalized_cases": lambda s, d: _cases(s, d, True),
    "q_whole_cases": lambda s, d: _cases(s, d, False),
    "q_imaging_findings": _findings,
    "q_report_findings": _report_findings,
    "q_rule_scores": _scores,
    "q_latest_cases": _latest_cases,
    "q_evidence_trace": _trace,
    "q_plan_check": _plan_faults,
    "q_source_rank": lambda s, d: pyramid(_json_nodes(s, d)).select("_ord", "pyramid_rank"),
    "q_source_violations": lambda s, d: violations(_json_nodes(s, d), _edges(s, d)).where(F.col("check") == "missing_field").select("row", "detail"),
    "q_source_retrieve": lambda s, d: retrieve(_json_nodes(s, d), QUESTIONS, fallback=False).select("qid", "_ord", "score"),
    "q_case_evidence": _case_evidence,
}

_DANGLING_SQL = """SELECT _ord, 'source' AS endpoint FROM evidence_edges WHERE source IS NULL OR source NOT IN (SELECT id FROM evidence_nodes WHERE id IS NOT NULL)
UNION ALL SELECT _ord, 'target' FROM evidence_edges WHERE target IS NULL OR target NOT IN (SELECT id FROM evidence_nodes WHERE id IS NOT NULL)"""
_VALUES = ", ".join(f"({_quoted(r)})" for r in RELATIONS)
_TYPES = ", ".join(f"({_quoted(k)}, {_quoted(EVIDENCE_LABELS[k])}, {o}::BIGINT)" for k, o in EVIDENCE_ORDER.items())
_HIGH = f"evidence_type IN ({', '.join(map(_quoted, HIGH_LEVEL))})"
_SUPPORTS = f"({_HIGH} AND starts_with(coalesce(recommendation_direction, ''), 'support'))"
_FLAGS = ("consolidation", "multilobar", "pleural_effusion", "atelectasis", "necrotizing_pneumonia")



def _section_json(s: str) -> str:
    return f"CASE WHEN json_type(o -> '{s}') = 'ARRAY' THEN o -> '{s}' -> 0 ELSE o -> '{s}' END"


def _leaf_json(s: str, f: str) -> str:
    return f"(({_section_json(s)}) -> '{f}')"


_JSON_NUMBERS = "('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT')"


def _number_sql(j: str, default: str = "NULL") -> str:
    return f"coalesce(CASE WHEN json_type({j}) = 'VARCHAR' THEN try_cast(trim({j} ->> '$') AS DOUBLE) WHEN json_type({j}) = 'BOOLEAN' THEN CASE WHEN CAST({j} AS VARCHAR) = 'true' THEN 1 ELSE 0 END WHEN json_type({j}) IN {_JSON_NUMBERS} THEN CAST({j} AS DOUBLE) END, {default})"


def _filled_sql(s: str) -> str:
    j = f"(o -> '{s}')"
    return f"coalesce(CASE json_type({j}) WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN CAST({j} AS VARCHAR) = 'true' WHEN 'VARCHAR' THEN {j} ->> '$' <> '' WHEN 'ARRAY' THEN json_array_length({j}) > 0 WHEN 'OBJECT' THEN len(json_keys({j})) > 0 ELSE CAST({j} AS DOUBLE) <> 0 END, false)"


def _word_sql(j: str, default: str) -> str:
    return f"CASE WHEN {j} IS NULL THEN '{default}' WHEN json_type({j}) = 'NULL' THEN 'none' ELSE lower({j} ->> '$') END"


def _normalized_sql() -> str:
    cough = _leaf_json("symptoms", "cough")
    flag = f"coalesce(CASE WHEN json_type({cough}) = 'BOOLEAN' THEN CAST({cough} AS VARCHAR) = 'true' WHEN json_type({cough}) = 'VARCHAR' THEN lower(trim({cough} ->> '$')) IN ('1', 'true', 'yes', 'y', 'positive', 'present') WHEN json_type({cough}) IN {_JSON_NUMBERS} THEN CAST({cough} AS DOUBLE) <> 0 END, false)"
    present = "concat_ws(',', " + ", ".join(f"CASE WHEN {_filled_sql(s)} THEN '{s}' END" for s in SECTIONS) + ")"
    absent = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_filled_sql(s)} THEN '{s}' END" for s in EXPECTED) + ")"
    return CASES_SQL + f"""z AS (SELECT 1) SELECT raw_id, case_no, CASE WHEN (o -> 'case_id') IS NULL THEN 'unknown_case' ELSE coalesce(o ->> 'case_id', 'None') END AS case_id, {_number_sql("(o -> 'age_years')")} AS age_years,
{_number_sql(_leaf_json('symptoms', 'fever_days'), '0')} AS symptoms_fever_days, {flag} AS symptoms_cough, {_number_sql(_leaf_json('labs', 'crp_mg_l'))} AS labs_crp_mg_l,
{_word_sql(_leaf_json('pathogen', 'mycoplasma_pcr'), '')} AS pathogen_mycoplasma_pcr, {_word_sql(_leaf_json('treatment_history', 'response'), '')} AS treatment_history_response, {present} AS modalities, {absent} AS missing_sections FROM cs"""


def _picked_sql(s: str, f: str, number: bool) -> str:
    usable = f"coalesce(isfinite({_number_sql('j')}), false)" if number else "coalesce(json_type(j) NOT IN ('NULL', 'OBJECT', 'ARRAY') AND trim(j ->> '$') <> '', false)"
    elements = f"CASE WHEN json_type(o -> '{s}') = 'ARRAY' THEN json_extract(o -> '{s}', '$[*]') ELSE [o -> '{s}'] END"
    values = f"list_filter(list_transform({elements}, lambda e: json_extract(e, '$.{f}')), lambda j: j IS NOT NULL)"
    return f"coalesce(list_filter({values}, lambda j: {usable})[1], {values}[1]) AS {f}"


def _whole_cases_sql() -> str:
    picked = ", ".join(_picked_sql(s, f, n) for s, f, n in (("symptoms", "fever_days", True), ("symptoms", "cough", False), ("labs", "crp_mg_l", True), ("pathogen", "mycoplasma_pcr", False), ("treatment_history", "response", False)))
    flag = f"coalesce(CASE WHEN json_type(cough) = 'BOOLEAN' THEN CAST(cough AS VARCHAR) = 'true' WHEN json_type(cough) = 'VARCHAR' THEN lower(trim(cough ->> '$')) IN ('1', 'true', 'yes', 'y', 'positive', 'present') WHEN json_type(cough) IN {_JSON_NUMBERS} THEN CAST(cough AS DOUBLE) <> 0 END, false)"
    present = "concat_ws(',', " + ", ".join(f"CASE WHEN {_filled_sql(s)} THEN '{s}' END" for s in SECTIONS) + ")"
    absent = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_filled_sql(s)} THEN '{s}' END" for s in EXPECTED) + ")"
    return CASES_SQL + f"""z AS (SELECT raw_id, case_no, o, {picked} FROM cs) SELECT raw_id, case_no, CASE WHEN (o -> 'case_id') IS NULL THEN 'unknown_case' ELSE coalesce(o ->> 'case_id', 'None') END AS case_id, {_number_sql("(o -> 'age_years')")} AS age_years,
{_number_sql('fever_days', '0')} AS symptoms_fever_days, {flag} AS symptoms_cough, {_number_sql('crp_mg_l')} AS labs_crp_mg_l,
{_word_sql('mycoplasma_pcr', '')} AS pathogen_mycoplasma_pcr, {_word_sql('response', '')} AS treatment_history_response, {present} AS modalities, {absent} AS missing_sections FROM z"""


_LEADING_SQL = _RETRIEVED + f""", p AS (SELECT qid, r._ord, r.evidence_type, n.citation, n.main_findings, row_number() OVER (PARTITION BY qid, r.evidence_type ORDER BY {_quality_sql('r.quality')}, coalesce(r.year, 0) DESC, coalesce(r.month, 0) DESC, coalesce(r.id, ''), r._ord) AS place,
  count(*) OVER (PARTITION BY qid, r.evidence_type) AS records FROM r JOIN evidence_nodes n ON n._ord = r._ord WHERE (types IS NULL OR list_contains(types, r.evidence_type)) AND r.evidence_type IN ({', '.join(map(_quoted, EVIDENCE_ORDER))})),
l AS (SELECT qid, evidence_type, {_case('evidence_type', EVIDENCE_ORDER, 6)} AS ord, records, list('- **' || coalesce(citation, '') || '**：' || coalesce(main_findings, '') ORDER BY place) AS lines FROM p WHERE place <= 3 GROUP BY ALL)
"""
_PLACED_SQL = _RETRIEVED + f""", p AS (SELECT qid, _ord, id, evidence_type, row_number() OVER (PARTITION BY qid ORDER BY {_PYRAMID}) AS place FROM r WHERE types IS NULL OR list_contains(types, evidence_type)),
d AS (SELECT DISTINCT qid, id FROM p),
x AS (SELECT a.qid, e.* FROM evidence_edges e JOIN d a ON e.source = a.id JOIN d b ON e.target = b.id AND a.qid = b.qid)
"""


def _json_sql(fields: list[str], of: str) -> str:
    return f"CAST(to_json(struct_pack({', '.join(f'{c} := {of}.{c}' for c in fields)})) AS VARCHAR)"


_LABEL = _case("evidence_type", {k: _quoted(v) for k, v in EVIDENCE_LABELS.items()}, "''")
_KIND = _case("evidence_type", {k: _quoted(v) for k, v in EVIDENCE_LABELS.items()}, "'other'")
_KIND_NO = _case("evidence_type", EVIDENCE_ORDER, 6)
_STEPS_SQL = ", ".join(f"({i}, {_quoted(x)})" for i, x in enumerate(STEPS))

_WHOLE_JSON = f"to_json(struct_pack({', '.join(f'{c} := {c}' for c in NODE_FIELDS)}))"
_SOURCE_RETRIEVED = f"""WITH {_Q}, k AS (SELECT qid, list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+'), lambda t: lower(t)) AS toks FROM q),
h AS (SELECT _ord, lower(CAST(CASE WHEN _ord % 2 = 1 THEN {_WHOLE_JSON} ELSE json_merge_patch('{{}}'::JSON, {_WHOLE_JSON}) END AS VARCHAR)) AS hay FROM evidence_nodes),
s AS (SELECT qid, _ord, len(list_filter(toks, lambda t: contains(hay, t))) AS score FROM k, h)
"""
_CASE_EVIDENCE_SQL = f"""WITH c AS ({_rules_sql()}),
q AS (SELECT case_ord AS qid, concat_ws(' ', 'rule_level', rule_level, 'rule_reasons', rule_reasons, 'mycoplasma', lower(coalesce(pathogen.mycoplasma_pcr, '')), 'treatment', lower(coalesce(treatment_history.response, ''))) AS text FROM c JOIN patient_cases p USING (case_ord)),
w AS (SELECT qid, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS asked FROM q),
k AS (SELECT _ord, id, topic, {_KB_WORDS.format(parts=_KB_PARTS)} AS words FROM knowledge_base),
s AS (SELECT qid, _ord, id, CASE WHEN len(list_intersect(asked, words)) = 0 AND topic IN ({', '.join(map(_quoted, FLOOR_TOPICS))}) THEN 1 ELSE len(list_intersect(asked, words)) END AS score FROM w, k)
SELECT qid, id, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, _ord) AS place FROM s WHERE score > 0 QUALIFY place <= 5"""

SQL: dict[str, str] = {
    "q_normalized_cases": _normalized_sql(),
    "q_whole_cases": _whole_cases_sql(),
    "q_top3_payloads": _LEADING_SQL + f"""SELECT q.qid, CAST(to_json(struct_pack(question := q.text, ranked_evidence := coalesce((SELECT list(struct_pack(type := evidence_type, records := records, lines := lines) ORDER BY ord) FROM l WHERE l.qid = q.qid), []),
pyramid_order := [{', '.join(map(_quoted, EVIDENCE_ORDER))}])) AS VARCHAR) AS payload FROM q""",
    "q_payloads": _PLACED_SQL + f"""SELECT p.qid, 'ranked_evidence' AS part, p.place AS position, {_json_sql(NODE_FIELDS, 'n')} AS value FROM p JOIN evidence_nodes n ON n._ord = p._ord
UNION ALL SELECT qid, 'evidence_edges', _ord, {_json_sql(EDGE_FIELDS, 'x')} FROM x
UNION ALL SELECT qid, 'question', 0, CAST(to_json(struct_pack(question := text)) AS VARCHAR) FROM q
UNION ALL SELECT qid, 'pyramid_order', ord, CAST(to_json(struct_pack(type := key)) AS VARCHAR) FROM q, (VALUES {_TYPES}) AS v(key, label, ord)""",
    "q_reports": _PLACED_SQL + f""", t AS (SELECT qid, {_KIND_NO} AS ord, {_KIND} AS kind, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT qid, relation, sum(n) AS n FROM (SELECT qid, coalesce(relation, '') AS relation, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT qid, rel, 0 FROM q, (VALUES {_VALUES}) AS v(rel)) GROUP BY ALL),
o AS (SELECT qid, 0 AS step_no, 0 AS line_no, NULL AS node_id, text AS line FROM q
UNION ALL SELECT qid, 1, ord, NULL, '- **' || kind || '** ' || n FROM t
UNION ALL SELECT p.qid, {_case('p.evidence_type', STEP_OF, 6)}, p.place, p.id, '- **' || coalesce(n.citation, '') || '**：' || coalesce(n.main_findings, '') FROM p JOIN evidence_nodes n ON n._ord = p._ord
UNION ALL SELECT qid, 7, ord, NULL, '| ' || kind || ' | ' || n || ' |  |' FROM t
UNION ALL SELECT q.qid, 7, 7, NULL, coalesce((SELECT count(*) FROM p WHERE p.qid = q.qid), 0) || ' records, ' || coalesce((SELECT count(*) FROM x WHERE x.qid = q.qid), 0) || ' relations.' FROM q
UNION ALL SELECT qid, 7, {_case('relation', {r: 8 + i for i, r in enumerate(RELATIONS)}, 8 + len(RELATIONS))}, NULL, '- ' || relation || ': ' || n FROM e)
SELECT qid, step_no, step, line_no, node_id, line FROM o JOIN (VALUES {_STEPS_SQL}) AS v(i, step) ON i = step_no""",
    "q_top3_reports": _LEADING_SQL + f""", d AS (SELECT DISTINCT qid, id FROM r WHERE types IS NULL OR list_contains(types, evidence_type)),
g AS (SELECT a.qid, count(*) AS edges FROM evidence_edges e JOIN d a ON e.source = a.id JOIN d b ON e.target = b.id AND a.qid = b.qid GROUP BY 1),
t AS (SELECT qid, string_agg('- **' || {_LABEL} || '** ' || records, chr(10) ORDER BY ord) AS inventory, string_agg('| ' || {_LABEL} || ' | ' || records || ' |  |', chr(10) ORDER BY ord) AS table_rows,
  string_agg('#### ' || {_LABEL} || chr(10) || array_to_string(lines, chr(10)) || CASE WHEN records > len(lines) THEN chr(10) || '- and ' || (records - len(lines)) || ' more' ELSE '' END, chr(10) ORDER BY ord) AS blocks FROM l GROUP BY 1)
SELECT q.qid, '## Question' || repeat(chr(10), 2) || '**' || q.text || '**' || repeat(chr(10), 2) || '### Evidence found' || repeat(chr(10), 2) || coalesce(inventory, '') || repeat(chr(10), 2) || '### Leading evidence' || repeat(chr(10), 2) || coalesce(blocks, '')
  || repeat(chr(10), 2) || '### Synthesis' || repeat(chr(10), 2) || '| type | records | role |' || chr(10) || '|---|---:|---|' || chr(10) || coalesce(table_rows, '') || repeat(chr(10), 2) || 'Relations among the evidence: ' || coalesce(edges, 0) || '.' AS report
FROM q LEFT JOIN t USING (qid) LEFT JOIN g USING (qid)""",
    "q_tokens": f"SELECT _ord, array_to_string(list_transform(regexp_extract_all(title, '[a-zA-Z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+'), lambda t: lower(t)), '|') AS mixed, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title), '{ASCII_TOKEN}'))), '|'), '') AS words FROM evidence_nodes",
    "q_token_counts": f"SELECT _ord, coalesce(len(regexp_extract_all(title, '[a-zA-Z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+')), 0) AS mixed, coalesce(len(list_distinct(regexp_extract_all(lower(title), '{ASCII_TOKEN}'))), 0) AS words FROM evidence_nodes",
    "q_retrieve": _RETRIEVED + f"SELECT qid, _ord, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {_case('evidence_type', EVIDENCE_ORDER, 6)}, coalesce(year, 0) DESC, coalesce(id, ''), _ord) AS place FROM r",
    "q_retrieve_by_type": _RETRIEVED + f"SELECT qid, _ord, row_number() OVER (PARTITION BY qid ORDER BY {_PYRAMID}) AS place FROM r WHERE types IS NULL OR list_contains(types, evidence_type)",
    "q_pyramid_rank": f"SELECT _ord, row_number() OVER (ORDER BY {_PYRAMID}) AS pyramid_rank FROM evidence_nodes",
    "q_type_inventory": f"SELECT key, label, ord, count(n._ord) AS nodes FROM (VALUES {_TYPES}) AS v(key, label, ord) LEFT JOIN evidence_nodes n ON n.evidence_type = key GROUP BY ALL",
    "q_lane_positions": f"SELECT _ord, dense_rank() OVER (ORDER BY {_case('evidence_type', EVIDENCE_ORDER, 6)}) - 1 AS lane, row_number() OVER (PARTITION BY evidence_type ORDER BY {_PYRAMID}) - 1 AS row_index FROM evidence_nodes WHERE evidence_type IN ({', '.join(map(_quoted, EVIDENCE_ORDER))})",
    "q_relation_counts": f"SELECT relation, CAST(sum(n) AS BIGINT) AS edges FROM (SELECT relation, count(*) AS n FROM evidence_edges GROUP BY 1 UNION ALL SELECT r, 0 FROM (VALUES {_VALUES}) AS v(r)) GROUP BY 1",
    "q_edges_by_relation": "SELECT _ord, relation, row_number() OVER (PARTITION BY relation ORDER BY _ord) AS position FROM evidence_edges",
    "q_induced_subgraph": _RETRIEVED + ", p AS (SELECT DISTINCT qid, id FROM r WHERE types IS NULL OR list_contains(types, evidence_type)) SELECT a.qid, e._ord, e.relation FROM evidence_edges e JOIN p a ON e.source = a.id JOIN p b ON e.target = b.id AND a.qid = b.qid",
    "q_high_level_relations": f"SELECT relation, count(*) AS edges FROM evidence_edges WHERE source IN (SELECT id FROM evidence_nodes WHERE {_HIGH}) AND target IN (SELECT id FROM evidence_nodes WHERE {_HIGH}) GROUP BY 1",
    "q_dangling_edges": _DANGLING_SQL,
    "q_duplicate_ids": "SELECT id, count(*) AS rows FROM evidence_nodes GROUP BY 1 HAVING count(*) > 1",
    "q_graph_violations": f"""SELECT "check", detail, count(*) AS n FROM (
SELECT 'duplicate_id' AS "check", id AS detail FROM evidence_nodes GROUP BY id HAVING count(*) > 1
{''.join(f" UNION ALL SELECT 'missing_field', '{c}' FROM evidence_nodes WHERE {c} IS NULL" for c in REQUIRED)}
UNION ALL SELECT 'unknown_type', evidence_type FROM evidence_nodes WHERE evidence_type NOT IN ({', '.join(map(_quoted, EVIDENCE_ORDER))})
UNION ALL SELECT 'dangling_edge', endpoint FROM ({_DANGLING_SQL})) GROUP BY ALL""",
    "q_graph_health": f"""SELECT (SELECT count(*) FROM evidence_nodes) AS nodes, (SELECT count(*) FROM evidence_edges) AS edges,
NOT EXISTS (SELECT 1 FROM evidence_nodes GROUP BY id HAVING count(*) > 1) AND NOT EXISTS (SELECT 1 FROM evidence_nodes WHERE {' OR '.join(f'{c} IS NULL' for c in REQUIRED)} OR evidence_type NOT IN ({', '.join(map(_quoted, EVIDENCE_ORDER))}))
AND NOT EXISTS ({_DANGLING_SQL}) AS graph_valid""",
    "q_neighbours": f"SELECT source AS id FROM evidence_edges WHERE target = '{NODE_OF_INTEREST}' AND source IS NOT NULL UNION SELECT target FROM evidence_edges WHERE source = '{NODE_OF_INTEREST}' AND target IS NOT NULL UNION SELECT '{NODE_OF_INTEREST}'",
    "q_knowledge_top": _top_sql("coalesce(id, ''), " + _KB_PARTS, False) + "SELECT qid, id, score, place FROM t",
    "q_knowledge_for_case": _top_sql(_KB_PARTS, True) + "SELECT qid, id, score, place FROM t",
    "q_knowledge_text": _top_sql("coalesce(id, ''), " + _KB_PARTS, False) + f"SELECT q.qid, coalesce(string_agg('[' || coalesce(id, 'None') || '] ' || coalesce(topic, 'None') || ': ' || coalesce(statement, 'None') || ' Use: ' || coalesce(clinical_use, 'None'), chr(10) ORDER BY place) FILTER (WHERE place IS NOT NULL), {_quoted(NOTHING_FOUND)}) AS text FROM q LEFT JOIN t USING (qid) GROUP BY q.qid",
    "q_support": f"SELECT year, count(*) AS records, count(*) FILTER (WHERE {_SUPPORTS}) AS in_support, coalesce(bool_or({_SUPPORTS} AND coalesce(dose_signal IN ({', '.join(map(_quoted, LOW_DOSE))}), false)), false) AS low_dose FROM evidence_nodes GROUP BY 1",
    "q_top3_highlights": f"SELECT evidence_type, string_agg(coalesce(citation, '') || '：' || coalesce(main_findings, ''), '；' ORDER BY place) AS text FROM (SELECT *, row_number() OVER (PARTITION BY evidence_type ORDER BY {_PYRAMID}) AS place FROM evidence_nodes WHERE evidence_type IS NOT NULL) WHERE place <= 3 GROUP BY 1",
    "q_highlights": f"SELECT evidence_type, (place + 99) // 100 AS chunk_no, count(*) AS records, string_agg(coalesce(citation, '') || '：' || coalesce(main_findings, ''), '；' ORDER BY place) AS text FROM (SELECT *, row_number() OVER (PARTITION BY evidence_type ORDER BY {_PYRAMID}) AS place FROM evidence_nodes) GROUP BY ALL",
    "q_top3_evidence": _LEADING_SQL + "SELECT qid, evidence_type, records, array_to_string(lines, chr(10)) AS lines FROM l",
    "q_first_record": f"SELECT _ord, id FROM evidence_nodes WHERE evidence_type IN ('systematic_review', 'case_report') ORDER BY {_PYRAMID} LIMIT 1",
    "q_title_wrap": "SELECT _ord, substr(coalesce(title, ''), 1, 12) || CASE WHEN length(title) > 24 THEN '|' || substr(title, 13, 11) || '…' WHEN length(title) > 12 THEN '|' || substr(title, 13, 12) ELSE '' END AS wrapped FROM evidence_nodes",
    "q_imaging_findings": "SELECT case_ord, " + ", ".join(f"({f'coalesce(imaging.image_features.{f}, false) OR ' if f in _FLAGS else ''}{_affirmed_sql('imaging.radiology_report', p)}) AS imaging_{f}" for f, p in IMAGING_PHRASES.items()) + " FROM patient_cases",
    "q_report_findings": "SELECT case_ord, " + ", ".join(f"{_affirmed_sql('imaging.radiology_report', p)} AS {f}" for f, p in IMAGING_PHRASES.items()) + " FROM patient_cases",
    "q_rule_scores": _rules_sql(),
    "q_latest_cases": "SELECT case_id, case_ord, age_years FROM patient_cases QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC NULLS LAST, case_ord DESC) = 1",
    "q_evidence_trace": "WITH u AS (SELECT DISTINCT target AS evidence_id FROM evidence_edges WHERE target IS NOT NULL), k AS (SELECT * FROM evidence_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY _ord DESC) = 1) SELECT evidence_id, coalesce(evidence_type, 'not_retrieved') AS topic, coalesce(main_findings, '') AS statement FROM u LEFT JOIN k ON k.id = evidence_id",
    "q_plan_check": f"""WITH p AS (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS step, l_linenumber AS id,
  CASE l_returnflag WHEN 'A' THEN 'quantitative' WHEN 'N' THEN 'qualitative' ELSE l_returnflag END AS kind, [l_suppkey % 12, l_partkey % 11] AS tools, [l_linenumber - 1, l_partkey % 5] AS inputs FROM lineitem)
SELECT plan, step, 'id' AS "check", CAST(id AS VARCHAR) AS detail FROM p WHERE id <> step
UNION ALL SELECT plan, step, 'action_type', kind FROM p WHERE kind NOT IN ('quantitative', 'qualitative')
UNION ALL SELECT plan, step, 'tool', array_to_string(list_filter(tools, lambda t: t > 9), ',') FROM p WHERE len(list_filter(tools, lambda t: t > 9)) > 0
UNION ALL SELECT plan, step, 'input', array_to_string(list_filter(inputs, lambda i: i < 0 OR i >= step), ',') FROM p WHERE len(list_filter(inputs, lambda i: i < 0 OR i >= step)) > 0""",
    "q_source_rank": f"SELECT _ord, row_number() OVER (ORDER BY {_PYRAMID.replace('WHEN quality IS NULL THEN', 'WHEN quality IS NULL AND _ord % 2 = 0 THEN')}) AS pyramid_rank FROM evidence_nodes",
    "q_source_violations": " UNION ALL ".join(f"SELECT _ord AS row, '{c}' AS detail FROM evidence_nodes WHERE {c} IS NULL AND _ord % 2 = 0" for c in REQUIRED),
    "q_source_retrieve": _SOURCE_RETRIEVED + "SELECT qid, _ord, score FROM s WHERE score > 0",
    "q_case_evidence": _CASE_EVIDENCE_SQL,
}
# The same searches with titles as questions.
SQL |= {f"q_title_{k}": SQL[f"q_{k}"].replace(_Q, _TITLES) for k in ("retrieve", "knowledge_top", "knowledge_for_case")}
