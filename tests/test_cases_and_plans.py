from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairn.operators.cases import exploded_cases, normalized
from cairn.plans.workflow import Registry, called, check, compile_plan, latest, trace
from cairn.sources.json_documents import EDGE, NODE, array_documents, documents, write_json, write_records, write_text
from cairn.streaming.cases import normalized_stream, read_records, write_stream

CASE = {
    "case_id": "c/1", "age_years": "7", "symptoms": {"fever_days": 9, "cough": "yes", "dyspnea": 0}, "vitals": {"spo2": 93, "respiratory_distress": True}, "labs": {"crp_mg_l": "nan", "pct_ng_ml": ""},
    "pathogen": {"mycoplasma_pcr": "Positive", "macrolide_resistance": None}, "imaging": {"radiology_report": "Large effusion. No necrosis.", "image_features": {"consolidation": 1}}, "treatment_history": {"response": None}, "follow_up": {},
}


def test_normalized_case(spark):
    rows = [(1, json.dumps(CASE)), (2, json.dumps([{"case": 1}, None, {"symptoms": [{"cough": True}, {"cough": False}]}])), (3, None)]
    flat = {(r.raw_id, r.case_no): r for r in normalized(exploded_cases(spark.createDataFrame(rows, "raw_id bigint, payload string"), "raw_id", "payload")).collect()}
    assert set(flat) == {(1, 0), (2, 0), (2, 2)}
    r = flat[1, 0]
    assert (r.case_id, r.age_years, r.sex, r.symptoms_fever_days, r.symptoms_cough, r.symptoms_dyspnea, r.vitals_spo2) == ("c/1", 7.0, "", 9.0, True, False, 93.0)
    assert r.labs_crp_mg_l != r.labs_crp_mg_l and r.labs_pct_ng_ml is None
    assert (r.pathogen_mycoplasma_pcr, r.pathogen_mycoplasma_igm, r.pathogen_macrolide_resistance, r.treatment_history_response) == ("positive", "", "none", "none")
    assert (r.imaging_pleural_effusion, r.imaging_necrotizing_pneumonia, r.imaging_consolidation, r.imaging_multilobar) == (True, False, True, False)
    assert r.modalities == ["symptoms", "vitals", "labs", "pathogen", "imaging", "treatment_history"] and r.missing_sections == []
    assert flat[2, 0].case_id == "unknown_case" and len(flat[2, 0].missing_sections) == 5 and flat[2, 2].symptoms_cough is True


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "nodes.json").write_text(json.dumps([{"id": "b", "year": 2020, "tags": ["x", None]}, {"id": "a", "title": "重"}, 5]))
    rows = array_documents(spark, str(tmp_path / "nodes.json"), NODE).orderBy("_ord").collect()
    assert [(r._ord, r.id, r.year, r.tags, r.title) for r in rows] == [(0, "b", 2020, ["x", None], None), (1, "a", None, None, "重"), (2, None, None, None, None)]
    assert json.loads(rows[1]._raw) == {"id": "a", "title": "重"}
    assert array_documents(spark, str(tmp_path / "none.json"), EDGE, missing_ok=True).count() == 0
    with pytest.raises(Exception):
        array_documents(spark, str(tmp_path / "none.json"), EDGE)
    (tmp_path / "bad.json").write_text("{")
    assert documents(spark, str(tmp_path / "bad.json")).first().doc is None
    df = spark.createDataFrame([("c/1", "t"), (None, None)], "case_id string, text string")
    write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    write_text(df, "text", str(tmp_path / "t"))
    write_records(df, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["_folder=c_1", "_folder=unknown_case"]


STEP = {"id": 1, "layer": "l", "tool": [1], "action_type": "qualitative", "action": "a", "input_type": [0], "output_type": "o", "output_path": "p", "proposal_task": "x"}


def test_plan(spark):
    registry = Registry()

    @registry.operator("double")
    def double(df):
        return df.withColumn("x", F.col("x") * 2)

    @registry.operator("both")
    def both(a, b):
        return a.unionByName(b)

    tools = [{"id": 1, "command": "double(x)"}, {"id": 2, "command": " both (a, b)"}]
    plan = [STEP, STEP | {"id": 2, "tool": [2], "input_type": [0, 1]}]
    raw = spark.createDataFrame([(3,)], "x int")
    assert sorted(r.x for r in compile_plan(raw, plan, tools, registry)[2].collect()) == [3, 6]
    assert called("f(a)") == "f" and called(None) == ""
    assert [v.check for v in check([STEP | {"id": 2}, STEP | {"id": 2, "input_type": [3]}])] == ["id", "input"]
    assert [(v.check, v.detail) for v in check([{k: v for k, v in STEP.items() if k != "proposal_task"}])] == [("fields", "proposal_task")]
    with pytest.raises(ValueError):
        compile_plan(raw, [STEP | {"tool": [1, 2]}], tools, registry)
    with pytest.raises(ValueError):
        compile_plan(raw, [STEP | {"tool": [7]}], tools, registry)
    with pytest.raises(KeyError):
        compile_plan(raw, [STEP], [{"id": 1, "command": "other"}], registry)


def test_latest_and_trace(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "new"), (None, 1, "n"), ("b", 3, "x"), ("b", 3, "x")], "k string, at int, v string")
    assert sorted((r.k or "", r.at, r.v) for r in latest(df, ["k"], ["at"]).collect()) == [("", 1, "n"), ("a", 2, "new"), ("b", 3, "x")]
    kb = spark.createDataFrame([("x", 0, "t", "old"), ("x", 1, "t", "new"), ("y", 2, None, None)], "id string, _ord bigint, topic string, statement string")
    used = spark.createDataFrame([("x",), ("x",), ("y",), ("z",), (None,)], "evidence_id string")
    assert sorted(map(tuple, trace(used, kb).collect())) == [("x", "t", "new"), ("y", "not_retrieved", ""), ("z", "not_retrieved", "")]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, json.dumps(CASE | {"case_id": f"c{i}"})) for i in range(5)], "raw_id bigint, payload string").withColumn("site_code", F.lit("s")).withColumn("received_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    stream = normalized_stream(read_records(spark, str(tmp_path / "in")))
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = normalized(exploded_cases(df, "raw_id", "payload"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_plans_in_a_table(spark):
    from cairn.plans.workflow import step_violations

    rows = [(1, 1, 1, "quantitative", [1], [0]), (1, 2, 3, "odd", [], [0, 2]), (2, 1, None, None, None, None), (2, 2, 2, "qualitative", [1, 9, 8], [-1, 1])]
    steps = spark.createDataFrame(rows, "plan bigint, position bigint, id bigint, action_type string, tools array<bigint>, inputs array<bigint>")
    got = sorted(map(tuple, step_violations(steps, [1, 2]).collect()))
    assert got == [(1, 2, "action_type", "odd"), (1, 2, "id", "3"), (1, 2, "input", "2"), (1, 2, "tool", "none"), (2, 1, "action_type", "none"), (2, 1, "id", "none"), (2, 1, "tool", "none"), (2, 2, "input", "-1"), (2, 2, "tool", "9,8")]


def test_a_folder_with_and_without_a_plan(spark, tmp_path):
    from cairn.plans.workflow import last_result, load_workflow

    folder = str(tmp_path)
    with pytest.raises(ValueError, match="toolset"):
        load_workflow(spark, folder)
    (tmp_path / "task.json").write_text(json.dumps({"name": "t"}))
    (tmp_path / "toolset.json").write_text(json.dumps([{"id": 1, "command": "double(x)"}]))
    with pytest.raises(ValueError, match="plan"):
        load_workflow(spark, folder)
    with pytest.raises(ValueError, match="tool 7"):
        load_workflow(spark, folder, lambda task, tools: [STEP | {"tool": [7]}])
    made = load_workflow(spark, folder, lambda task, tools: [STEP | {"action": task["name"]}])
    again = load_workflow(spark, folder, lambda task, tools: 1 / 0)
    assert made.plan == again.plan == [STEP | {"action": "t"}] and again.task == {"name": "t"}
    registry = Registry({"double": lambda df: df.withColumn("x", F.col("x") * 2)})
    results = compile_plan(spark.createDataFrame([(3,)], "x int"), again.plan, again.toolset, registry)
    assert last_result(results).first().x == 6
