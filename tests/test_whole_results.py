from __future__ import annotations

import json

from pyspark.sql import functions as F

from cairn.operators.cases import exploded_cases, normalized
from cairn.operators.graph import induced_each
from cairn.operators.report import payload_rows, report_lines
from cairn.operators.retrieval import NODE_FIELDS, Question, knowledge_top, of_types, pyramid_order, question_table, retrieve, title_questions
from cairn.operators.summary import type_summaries
from tests.test_evidence import node, nodes

EDGE = "_ord bigint, source string, target string, relation string, description string"
ASKED = [Question(1, "all"), Question(2, "none", ()), Question(3, "", ("guideline",))]


def many(spark):
    """Five guidelines, a case report, and records of an unknown and of no type."""
    return nodes(spark, *(node(i, f"g{i}", year=2020 + i, citation=f"G{i}", findings=f"x{i}") for i in range(5)), node(5, "c", "case_report", citation=None, findings=None), node(6, "o", "odd", citation="O"), node(7, "z", None))


def some_edges(spark):
    return spark.createDataFrame([(0, "g0", "g4", "updates", "d"), (1, "g0", "c", "updates", None), (2, "g1", "o", "odd", "e"), (3, "g1", "gone", "confirms", "f"), (4, None, "g1", "confirms", "f"), (5, "z", "g0", None, "g")], EDGE)


def placed(n):
    return pyramid_order(of_types(retrieve(n, ASKED)))


def test_payload_rows_hold_all_records_and_edges(spark):
    n = many(spark)
    rows = payload_rows(question_table(spark, ASKED), placed(n), n, some_edges(spark)).collect()
    part = {(q, p): [json.loads(r.value) for r in sorted((r for r in rows if (r.qid, r.part) == (q, p)), key=lambda r: r.position)] for q in (1, 2, 3) for p in ("question", "ranked_evidence", "evidence_edges", "pyramid_order")}
    assert [x["id"] for x in part[1, "ranked_evidence"]][:6] == ["g4", "g3", "g2", "g1", "g0", "c"] and {x["id"] for x in part[1, "ranked_evidence"][6:]} == {"o", "z"}
    assert [list(x) for x in part[1, "ranked_evidence"]] == [NODE_FIELDS] * 8
    assert part[1, "evidence_edges"][0] == {"source": "g0", "target": "g4", "relation": "updates", "description": "d"} and len(part[1, "evidence_edges"]) == 4
    assert part[2, "ranked_evidence"] == part[2, "evidence_edges"] == [] and part[2, "question"] == [{"question": "none"}] and len(part[2, "pyramid_order"]) == 6
    assert len(part[3, "ranked_evidence"]) == 5 and len(part[3, "evidence_edges"]) == 1


def test_edges_of_each_selection(spark):
    picked = spark.createDataFrame([(1, "g0"), (1, "g4"), (1, "g4"), (2, "g0"), (2, "c"), (3, None)], "qid bigint, id string")
    assert sorted((r.qid, r._ord) for r in induced_each(some_edges(spark), picked, "qid").collect()) == [(1, 0), (2, 1)]


def test_report_lines_hold_all_records_and_relations(spark):
    n = many(spark)
    lines = sorted(report_lines(question_table(spark, ASKED), placed(n), n, some_edges(spark)).collect(), key=lambda r: (r.qid, r.step_no, r.line_no, r.line))
    of = {(q, s): [(r.node_id, r.line) for r in lines if (r.qid, r.step) == (q, s)] for q in (1, 2, 3) for s in ("question", "inventory", "guidelines", "reviews", "lower_evidence", "other_evidence", "synthesis")}
    assert of[1, "guidelines"] == [(f"g{i}", f"- **G{i}**：x{i}") for i in (4, 3, 2, 1, 0)] and of[1, "lower_evidence"] == [("c", "- ****：")] and of[1, "reviews"] == []
    assert {x for x, _ in of[1, "other_evidence"]} == {"o", "z"} and [x for _, x in of[1, "inventory"]] == ["- **指南** 5", "- **病例报告** 1", "- **other** 2"]
    assert [x for _, x in of[1, "synthesis"]] == [
        "| 指南 | 5 |  |", "| 病例报告 | 1 |  |", "| other | 2 |  |", "8 records, 4 relations.", "- supports: 0", "- supplements: 0", "- updates: 2", "- confirms: 0", "- cautions: 0", "- : 1", "- odd: 1",
    ]
    assert of[2, "guidelines"] == [] and of[2, "question"] == [(None, "none")] and of[2, "synthesis"][0] == (None, "0 records, 0 relations.")
    assert len(of[3, "guidelines"]) == 5 and (None, "- updates: 1") in of[3, "synthesis"]


def test_summaries_hold_all_records_of_a_type(spark):
    got = {(r.evidence_type, r.chunk_no): (r.records, r.text) for r in type_summaries(many(spark), 2).collect()}
    assert got == {
        ("guideline", 1): (2, "G4：x4；G3：x3"), ("guideline", 2): (2, "G2：x2；G1：x1"), ("guideline", 3): (1, "G0：x0"),
        ("case_report", 1): (1, "："), ("odd", 1): (1, "O：f"), (None, 1): (1, "c：f"),
    }


def test_cases_take_leaves_from_later_elements(spark):
    case = {
        "symptoms": [None, {"fever_days": "x"}, {"fever_days": "6"}, {"fever_days": 7}], "labs": [{"pct_ng_ml": 2}, {"crp_mg_l": "nan"}, {"crp_mg_l": 31.5}], "vitals": [{"respiratory_distress": " "}, {"respiratory_distress": "yes"}],
        "pathogen": [{"mycoplasma_pcr": None}, {"mycoplasma_pcr": ""}, {"mycoplasma_pcr": "Positive"}], "imaging": [{"image_features": {"multilobar": None}}, {"image_features": {"multilobar": 1}, "radiology_report": "Consolidation."}],
        "treatment_history": [5, {"response": None}], "follow_up": [],
    }
    cases = exploded_cases(spark.createDataFrame([(1, json.dumps(case))], "raw_id bigint, payload string"), "raw_id", "payload")
    r = normalized(cases).first()
    assert (r.symptoms_fever_days, r.labs_pct_ng_ml, r.labs_crp_mg_l, r.vitals_respiratory_distress, r.pathogen_mycoplasma_pcr) == (6.0, 2.0, 31.5, True, "positive")
    assert (r.imaging_multilobar, r.imaging_consolidation, r.treatment_history_response, r.follow_up_poor_oral_intake) == (True, True, "none", False)
    first = normalized(cases, first_only=True).first()
    assert (first.symptoms_fever_days, first.labs_pct_ng_ml, first.labs_crp_mg_l, first.pathogen_mycoplasma_pcr) == (0.0, 2.0, None, "none")


def test_composite_references_of_all_cases(spark, tmp_path):
    from cairn.plans.problem_queries import p2_composite_all

    rows = [
        (0, "a", "x", "2020-01-01"), (1, "a", "x", "2021-01-01"), (2, "a", "y", "2024-02-01"), (3, "a", "y", "2024-03-01"), (4, None, "y", "2024-01-01"), (5, None, "y", "2024-04-01"),
        (6, "b", "x", None), (7, "b", "x", "2025-01-01"), (8, None, None, "2025-01-01"), (9, "a", "x", None), (10, "b", "x", "2025-01-01"), (11, "b", None, "2025-01-02"),
    ]
    cases = spark.createDataFrame(rows, "case_ord bigint, cohort_id string, site_code string, at string").withColumn("admitted_at", F.col("at").cast("timestamp_ntz")).drop("at")
    cases.write.parquet(str(tmp_path / "patient_cases.parquet"))
    assert sorted((r.case_ord, r.null_mask) for r in p2_composite_all(spark, str(tmp_path)).collect()) == [(0, "00"), (2, "00"), (4, "10"), (6, "00"), (7, "00"), (9, "00"), (10, "00")]


def test_titles_as_questions(spark):
    n = nodes(spark, *(node(i, f"i{i}", title=f"word{i} {'x' * (i % 7)}" if i else None) for i in range(120)))
    asked = title_questions(n)
    given = [Question(r.qid, r.text) for r in asked.collect()]
    assert sorted(q.qid for q in given) == [0, 50, 100] and given[0].text == ""
    found = {(r.qid, r._ord, r.score) for r in retrieve(n, asked).collect()}
    assert found == {(r.qid, r._ord, r.score) for r in retrieve(n, given).collect()} and len({x for x in found if x[0] == 0}) == 120
    kb = spark.createDataFrame([(0, "K1", "t", ["word50"], "s", "u"), (1, "K2", "t", None, "word100 xx", None)], "_ord bigint, id string, topic string, tags array<string>, statement string, clinical_use string")
    assert {(r.qid, r.id, r.score) for r in knowledge_top(kb, asked).collect()} == {(50, "K1", 1), (100, "K2", 2)}
