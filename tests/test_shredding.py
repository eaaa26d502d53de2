from __future__ import annotations

import json
import random

import numpy as np

from cairn.operators.shredding import _ordinals, leaf_rows, reconstruct, shred

SECTIONS = {"symptoms": "fever_days", "labs": "crp_mg_l"}
PATHS = [f"{s}.{leaf}" for s, leaf in SECTIONS.items()]


def cases_of(payload):
    try:
        v = json.loads(payload) if payload is not None else None
        if isinstance(v, str):
            v = json.loads(v)
    except ValueError:
        return []
    if isinstance(v, list):
        return v
    if not isinstance(v, dict):
        return []
    if isinstance(v.get("cases"), list):
        return v["cases"]
    return [v["case"]] if isinstance(v.get("case"), dict) else [v]


def brute(rows):
    out = set()
    for key, payload in rows:
        for c, case in enumerate(cases_of(payload)):
            if not isinstance(case, dict):
                continue
            for section, leaf in SECTIONS.items():
                items = case.get(section)
                for i, item in enumerate(items if isinstance(items, list) else [items]):
                    if isinstance(item, dict) and item.get(leaf) is not None and item[leaf] != "":
                        out.add((key, c, section, i))
    return out


def run(spark, rows):
    levels = shred(spark.createDataFrame(rows, "raw_id bigint, payload string"), "raw_id", "payload", PATHS)
    return {tuple(r) for r in leaf_rows(levels, "raw_id", SECTIONS, ["case_no", "item_no"]).collect()}


def test_written_cases(spark):
    rows = list(enumerate([
        '{"symptoms": {"fever_days": 3}, "labs": [{"crp_mg_l": 1}, null, {"crp_mg_l": ""}, {"crp_mg_l": 0}]}',
        '{"case": {"symptoms": [{"fever_days": null}, {"fever_days": "x"}]}}',
        '{"cases": [null, {"symptoms": {"fever_days": false}}, 7, {"labs": []}]}',
        '[{"labs": {"crp_mg_l": {"v": 1}}}, {"labs": {"crp_mg_l": []}}]',
        json.dumps('{"labs": {"crp_mg_l": 5}}'), json.dumps("not json"), json.dumps(json.dumps({"a": 1})),
        None, "", " ", "null", "3", '"x"', '{"labs": {"crp_mg_l": 1}', '{"labs": {"crp_mg_l": 1}} x', '{"labs": {"crp_mg_l": 1}}]', '1], [2', '{"labs": {"crp_mg_l": 1}},{}',
        '{"labs": [[{"crp_mg_l": 1}]], "symptoms": "fever_days"}', '{"x": {"labs": {"crp_mg_l": 1}}}',
        '{"labs": {"crp_mg_l": 1, "crp_mg_l": ""}}', '{"case": [{"labs": {"crp_mg_l": 1}}], "labs": {"crp_mg_l": 2}}',
        "{\"labs\": {'crp_mg_l': 1}}", '{"labs": {"crp_mg_l": NaN}}',
    ]))
    assert run(spark, rows) == brute([r for r in rows if r[1] is None or "NaN" not in r[1]])


def test_random_documents(spark):
    rnd = random.Random(3)

    def leaf():
        return rnd.choice([None, "", 0, 1.5, "a", True, [], {}, [1]])

    def section(name):
        one = lambda: rnd.choice([{name: leaf()}, {}, None, {"other": leaf()}, 5])
        return rnd.choice([one(), [one() for _ in range(rnd.randrange(4))], None])

    def case():
        return rnd.choice([{"symptoms": section("fever_days"), "labs": section("crp_mg_l")}, {"labs": section("crp_mg_l")}, None, []])

    docs = []
    for i in range(200):
        d = rnd.choice([case(), {"case": case()}, {"cases": [case() for _ in range(rnd.randrange(4))]}, [case() for _ in range(rnd.randrange(3))]])
        docs.append((i, json.dumps(json.dumps(d)) if rnd.random() < 0.2 else json.dumps(d)))
    assert run(spark, docs) == brute(docs)


def test_tables_link_to_parents(spark):
    payload = '{"cases": [{"case_id": "a", "h": {"c": [{"d": [{"mg": 1}, {"mg": 2}]}, {"d": []}, {"d": {"mg": 3}}]}}, {"case_id": "b"}]}'
    levels = shred(spark.createDataFrame([(9, payload), (10, None)], "raw_id bigint, payload string"), "raw_id", "payload", ["case_id", "h.c.d.mg"])
    assert {tuple(r)[:3] for r in reconstruct(levels, "raw_id", "", ["case_id"], ["case_no"]).collect()} == {(9, 0, "a"), (9, 1, "b")}
    doses = reconstruct(levels, "raw_id", "h.c.d", ["mg"], ["case_no", "h_no", "c_no", "d_no"])
    assert {tuple(r)[:6] for r in doses.collect()} == {(9, 0, 0, 0, 0, "1"), (9, 0, 0, 0, 1, "2"), (9, 0, 0, 2, 0, "3")}


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([(1, '{"labs": {"crp_mg_l": 1}}', "x", 2)], "raw_id bigint, payload string, `labs.crp_mg_l` string, _doc int")
    assert leaf_rows(shred(df, "raw_id", "payload", PATHS), "raw_id", SECTIONS, ["case_no", "item_no"]).count() == 1


def test_many_elements(spark):
    payload = json.dumps([{"labs": [{"crp_mg_l": i} for i in range(300)]} for _ in range(20)])
    got = run(spark, [(1, payload)])
    assert got == {(1, c, "labs", i) for c in range(20) for i in range(300)}


def test_ordinals_of_levels():
    r = np.array([0, 2, 2, 1, 2, 0, 1, 2])
    first, second = _ordinals(r, 2)
    assert first.tolist() == [0, 0, 0, 1, 1, 0, 1, 1]
    assert second.tolist() == [0, 1, 2, 0, 1, 0, 0, 1]


def test_documents_wrapped_in_many_strings(spark):
    inner = json.dumps({"symptoms": {"fever_days": 3}})
    rows, text = [], inner
    for n in range(8):
        rows.append((n, text))
        text = json.dumps(text)
    rows += [(20, json.dumps("plain")), (21, '"' + inner), (22, json.dumps(inner + " x"))]
    levels = shred(spark.createDataFrame(rows, "raw_id bigint, payload string"), "raw_id", "payload", ["symptoms.fever_days"])
    got = leaf_rows(levels, "raw_id", {"symptoms": "fever_days"}, ["case_no", "item_no"]).collect()
    assert sorted(r.raw_id for r in got) == list(range(8))
