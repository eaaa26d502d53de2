from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions.coerce import as_flag, as_number, as_word, child, filled
from cairn.functions.text import affirmed, json_object_in, mixed_tokens, token_set, wrapped_title
from cairn.operators.graph import dangling, edges_by_relation, induced, neighbours, relation_counts, violations
from cairn.operators.ranking import lane_positions, pyramid, ranked, type_inventory
from cairn.operators.retrieval import NOTHING_FOUND, Question, knowledge_for_case, knowledge_text, knowledge_top, of_types, pyramid_order, retrieval_order, retrieve
from cairn.operators.rules import Rule, apply_rules, at_least, below
from cairn.operators.summary import highlights, support

NODE = "_ord bigint, id string, title string, evidence_type string, year int, month int, source string, population string, intervention string, comparator string, main_findings string, quality string, recommendation_direction string, dose_signal string, safety_signals array<string>, tags array<string>, citation string"


def node(o, id_, kind="guideline", year=2024, month=1, quality="high", findings="f", tags=(), direction=None, dose=None, title="t", citation="c"):
    return (o, id_, title, kind, year, month, None, None, None, None, findings, quality, direction, dose, [], list(tags), citation)


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def variant(spark, json, column):
    return spark.createDataFrame([(json,)], "j string").select(F.parse_json("j").alias("v")).select(column(F.col("v")).alias("y")).first().y


def test_tokens(spark):
    assert one(spark, mixed_tokens(F.col("x")), "重症SMPP_a 儿童 smpp，a") == ["重症", "smpp", "a", "儿童", "smpp", "a"]
    assert one(spark, token_set(F.col("x")), "A_b a_B 重 c c") == ["a_b", "c"]
    assert one(spark, token_set(F.col("x")), None) == []


@pytest.mark.parametrize("text,wanted", [
    ("No pleural effusion", False), ("No pleural effusions", True), ("Effusion present. No consolidation.", True), ("No effusion. Large effusion later.", False),
    ("without\neffusion", False), ("No fever. Effusion", True), ("未见effusion", True), (None, False), ("", False), ("negative for an effusion", False),
])
def test_negation(spark, text, wanted):
    assert one(spark, affirmed(F.col("x"), ["pleural effusion", "effusion"]), text) is wanted


def test_title_wrap(spark):
    for text, wanted in (("", []), ("abcdefghijkl", ["abcdefghijkl"]), ("重" * 13, ["重" * 12, "重"]), ("a" * 24, ["a" * 12] * 2), ("a" * 25, ["a" * 12, "a" * 11 + "…"]), (None, [])):
        assert one(spark, wrapped_title(F.col("x")), text) == wanted


@pytest.mark.parametrize("text,wanted", [('{"a":1}', True), ('```json\n{"a":1}\n```', True), ('```\n{"a":1}```', True), ('so: {"a":1} done', True), ('{"a":1} and {"b":2}', None), ("[1]", False), ("", False)])
def test_json_object_in_a_reply(spark, text, wanted):
    got = one(spark, json_object_in(F.col("x")).isNotNull(), text)
    assert wanted is None or got is wanted


def test_coercion(spark):
    number = {'{"a":1}': 1.0, '{"a":"2.5"}': 2.5, '{"a":" 3 "}': 3.0, '{"a":"abc"}': 9.0, '{"a":""}': 9.0, '{"a":null}': 9.0, "{}": 9.0, '{"a":true}': 1.0, '{"a":"1d"}': 9.0, '{"a":[1]}': 9.0, '{"a":"1e2"}': 100.0}
    for j, wanted in number.items():
        assert variant(spark, j, lambda v: as_number(child(v, "a"), 9.0)) == wanted, j
    flags = {'{"a":true}': True, '{"a":1}': True, '{"a":0}': False, '{"a":"Yes "}': True, '{"a":"Positive"}': True, '{"a":"t"}': False, '{"a":null}': False, "{}": False, '{"a":{}}': False, '{"a":0.5}': True}
    for j, wanted in flags.items():
        assert variant(spark, j, lambda v: as_flag(child(v, "a"))) is wanted, j
    words = {'{"a":"X"}': "x", '{"a":null}': "none", "{}": "d", '{"a":5}': "5"}
    for j, wanted in words.items():
        assert variant(spark, j, lambda v: as_word(child(v, "a"), "d")) == wanted, j
    there = {'{"a":{}}': False, '{"a":[]}': False, '{"a":""}': False, '{"a":0}': False, '{"a":null}': False, "{}": False, '{"a":{"b":1}}': True, '{"a":[0]}': True, '{"a":"x"}': True, '{"a":false}': False, '{"a":true}': True}
    for j, wanted in there.items():
        assert variant(spark, j, lambda v: filled(child(v, "a"))) is wanted, j


def test_retrieval_with_fallback(spark):
    n = nodes(spark, node(0, "a", tags=["smpp"]), node(1, "b", "case_report", 2020), node(2, "c", "editorial", None))
    asked = [Question(1, "SMPP 儿童"), Question(2, ""), Question(3, "zzz"), Question(4, "year"), Question(5, "smpp smpp"), Question(6, "", ()), Question(7, "", ("case_report",))]
    got = retrieve(n, asked)
    by = {}
    for r in retrieval_order(got).collect():
        by.setdefault(r.qid, []).append((r.place, r.id, r.score))
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in by.items()} == {
        1: [("a", 1)], 2: [("a", 0), ("b", 0), ("c", 0)], 3: [("a", 0), ("b", 0), ("c", 0)], 4: [("a", 1), ("b", 1)], 5: [("a", 2)],
        6: [("a", 0), ("b", 0), ("c", 0)], 7: [("a", 0), ("b", 0), ("c", 0)],
    }
    left = {(r.qid, r.id) for r in pyramid_order(of_types(got)).collect()}
    assert (7, "b") in left and (7, "a") not in left and not any(q == 6 for q, _ in left)


def test_pyramid(spark):
    rows = [node(0, "z"), node(1, "a"), node(2, "m", year=2025), node(3, "m2", quality="low"), node(4, "m3", quality=None), node(5, "m4", month=None), node(6, "m5", month=5), node(7, "n", "case_report"), node(8, "o", "other"), node(9, None, None)]
    order = [r.id for r in pyramid(nodes(spark, *rows)).orderBy("pyramid_rank").collect()]
    assert order == ["m", "m5", "a", "z", "m4", "m2", "m3", "n", None, "o"]


def test_distributed_rank_equals_a_sort(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot", "hot", f"g{rnd.randrange(9)}"]), rnd.randrange(50)) for i in range(1000)]
    got = ranked(spark.createDataFrame(rows, "i bigint, g string, v int"), [F.col("v").alias("_v"), F.col("i").alias("_i")], ["g"], partitions=7)
    want = {}
    for g in {r[1] for r in rows}:
        for at, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1):
            want[r[0]] = at
    assert {r.i: r["rank"] for r in got.collect()} == want


def test_lanes_and_inventory(spark):
    n = nodes(spark, node(0, "a"), node(1, "b"), node(2, "c", "case_report"), node(3, "d", "x"))
    assert {(r.id, r.lane, r.row_index) for r in lane_positions(n).collect()} == {("a", 0, 0), ("b", 0, 1), ("c", 1, 0)}
    assert {r.key: r.nodes for r in type_inventory(n).collect()} == {"guideline": 2, "systematic_review": 0, "randomized_controlled_trial": 0, "observational_study": 0, "narrative_review": 0, "case_report": 1}


def test_graph(spark):
    n = nodes(spark, node(0, "a"), node(1, "b"), node(2, "c", None), node(3, "c", "odd", findings=None))
    e = spark.createDataFrame([(0, "a", "b", "supports"), (1, "b", "a", "odd"), (2, "a", "x", "supports"), (3, None, "a", None), (4, "a", "a", "supports"), (5, "a", "b", "supports")], "_ord bigint, source string, target string, relation string")
    assert sorted(r._ord for r in induced(e, n.where("id IN ('a', 'b')")).collect()) == [0, 1, 4, 5]
    picked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "qid int, id string")
    assert sorted((r.qid, r._ord) for r in induced(e, picked, by=["qid"]).collect()) == [(1, 0), (1, 1), (1, 4), (1, 5), (2, 4)]
    assert {r.relation: r.edges for r in relation_counts(e).collect()} == {"supports": 4, "supplements": 0, "updates": 0, "confirms": 0, "cautions": 0, "odd": 1, None: 1}
    assert sorted((r._ord, r.position) for r in edges_by_relation(e).collect()) == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 3), (5, 4)]
    assert sorted(map(tuple, dangling(e, n).collect())) == [(2, "target"), (3, "source")]
    assert sorted(r.id for r in neighbours(e, "a").collect()) == ["a", "b", "x"]
    assert [r.id for r in neighbours(e, "nobody").collect()] == ["nobody"]
    assert sorted((r.check, r.row if r.row is not None else -1, r.detail) for r in violations(n, e).collect()) == [
        ("dangling_edge", 2, "target"), ("dangling_edge", 3, "source"), ("duplicate_id", -1, "c"), ("missing_field", 2, "evidence_type"), ("missing_field", 3, "main_findings"), ("unknown_type", 3, "odd"),
    ]


def test_knowledge(spark):
    kb = spark.createDataFrame(
        [(0, "K1", "diagnosis", ["x"], "alpha beta", "use"), (1, "K2", "imaging", None, "gamma", None), (2, "K3", "other", [None, "alpha"], None, ""), (3, "K4", "severity", [], "none", "")],
        "_ord bigint, id string, topic string, tags array<string>, statement string, clinical_use string",
    )
    asked = [Question(1, "alpha ALPHA k1"), Question(2, "zzz"), Question(3, "gamma alpha")]
    top = knowledge_top(kb, asked, 2)
    assert sorted((r.qid, r.place, r.id, r.score) for r in top.collect()) == [(1, 1, "K1", 2), (1, 2, "K3", 1), (3, 1, "K1", 1), (3, 2, "K2", 1)]
    assert sorted((r.qid, r.place, r.id) for r in knowledge_for_case(kb, asked, 3).collect()) == [(1, 1, "K1"), (1, 2, "K3"), (1, 3, "K4"), (2, 1, "K1"), (2, 2, "K4"), (3, 1, "K1"), (3, 2, "K2"), (3, 3, "K3")]
    texts = {r.qid: r.text for r in knowledge_text(top, asked).collect()}
    assert texts[2] == NOTHING_FOUND and texts[1].split("\n")[0] == "[K1] diagnosis: alpha beta Use: use"
    assert knowledge_top(kb.where("false"), asked).collect() == []


def test_summary(spark):
    n = nodes(spark, node(0, "a", direction="support_x", dose="low_dose_preferred"), node(1, "b", direction="supplement_support"), node(2, "c", "narrative_review", direction="support", dose="avoid_unnecessary_high_dose"))
    r = support(n).first()
    assert (r.records, r.in_support, r.low_dose) == (3, 1, True)
    assert tuple(support(n.where("id = 'c'")).first()) == (1, 0, False) and tuple(support(n.where("false")).first()) == (0, 0, False)
    assert {r.evidence_type: r.text for r in highlights(n, 1).collect()} == {"guideline": "c：f", "narrative_review": "c：f"}


def test_rules(spark):
    df = spark.createDataFrame([(1, 40.0, 91.0), (2, float("nan"), float("nan")), (3, None, None), (4, 39.9, 95.0)], "i int, crp double, spo2 double")
    rules = [Rule(at_least(F.col("crp"), 40), 0.15, "crp"), Rule(below(F.col("spo2"), 95), 0.9, "spo2"), Rule(F.col("crp") > 1e9, 5, "undecided")]
    got = {r.i: (r.x_score, r.x_level, r.x_reasons) for r in apply_rules(df, rules, [(1.0, "high"), (0.5, "some")], "low", "x", cap=1.0).collect()}
    assert got[1] == (1.0, "high", ["crp", "spo2"]) and got[3] == (0.0, "low", []) and got[4] == (0.0, "low", [])
    assert apply_rules(df, [], [], "low", "x").first().x_level == "low"


def test_reports(spark):
    import json

    from cairn.operators.ranking import first_in_pyramid
    from cairn.operators.report import Wording, leading, markdown, payload
    from cairn.operators.retrieval import faults, question_table

    n = nodes(spark, node(0, "a", citation="A", findings="x"), node(1, "b", citation=None, findings=None), node(2, "c", "case_report", citation="C", findings="y"), node(3, "d", "odd"))
    asked = [Question(1, "all"), Question(2, "none", ())]
    lead = leading(of_types(retrieve(n, asked)), n, 1)
    assert {(r.qid, r.evidence_type, r.records, tuple(r.lines)) for r in lead.collect()} == {(1, "guideline", 2, ("- **A**：x",)), (1, "case_report", 1, ("- **C**：y",))}
    relations = spark.createDataFrame([(1, 4)], "qid bigint, edges bigint")
    texts = {r.qid: r.report for r in markdown(question_table(spark, asked), lead, relations, Wording(roles={"guideline": "first"})).collect()}
    assert texts[1].split("\n") == [
        "## Question", "", "**all**", "", "### Evidence found", "", "- **指南** 2", "- **病例报告** 1", "", "### Leading evidence", "", "#### 指南", "- **A**：x", "- and 1 more", "#### 病例报告", "- **C**：y", "",
        "### Synthesis", "", "| type | records | role |", "|---|---:|---|", "| 指南 | 2 | first |", "| 病例报告 | 1 |  |", "", "Relations among the evidence: 4.",
    ]
    assert "**none**" in texts[2] and texts[2].endswith("evidence: 0.")
    sent = {r.qid: json.loads(r.payload) for r in payload(question_table(spark, asked), lead).collect()}
    assert [e["type"] for e in sent[1]["ranked_evidence"]] == ["guideline", "case_report"] and sent[2]["ranked_evidence"] == []
    assert faults([Question(1, " "), Question(2, "x", ("odd", "guideline"))]) == [(1, "empty_question", ""), (2, "invalid_evidence_type", "odd")]
    assert [r.id for r in first_in_pyramid(n, ["case_report", "odd"]).collect()] == ["c"]


def test_gateway(spark):
    from cairn.plans.gateway import with_replies
    from cairn.plans.workflow import merged

    def reply(p):
        if p == "fail":
            raise ValueError("no")
        return {"good": 'so: {"a": 1}', "odd": "text", "list": "[1]"}[p]

    df = spark.createDataFrame([(1, "good"), (2, "odd"), (3, "fail"), (4, "list")], "k bigint, p string")
    got = {r.k: r for r in with_replies(df, "p", reply).collect()}
    assert got[1].reply == '{"a":1}' and got[1].reply_used and got[1].reply_error is None
    assert [got[k].reply_used for k in (2, 3, 4)] == [False] * 3 and got[3].reply_error == "ValueError: no"
    assert not any(r.reply_used for r in with_replies(df, "p").collect())
    m = spark.createDataFrame([({"a": "1"},), (None,)], "m map<string,string>").select(merged(F.col("m"), "a", F.lit("2")).alias("m"))
    assert [r.m for r in m.collect()] == [{"a": "2"}, {"a": "2"}]


def test_replies_are_asked_for_once_per_row(spark, tmp_path):
    from cairn.plans.gateway import with_replies

    log = str(tmp_path / "calls")

    def reply(p):
        with open(log, "a") as f:
            f.write("x")
        return '{"v": "%s"}' % p

    df = spark.createDataFrame([("same", "a", "r"), ("same", "b", "r"), (None, "c", None)], "k string, p string, reply string").drop("reply").coalesce(1)
    got = with_replies(df, "p", reply)
    assert got.count() == 3 and sorted((r.k or "", r.p, r.reply) for r in got.collect()) == [("", "c", '{"v":"c"}'), ("same", "a", '{"v":"a"}'), ("same", "b", '{"v":"b"}')]
    assert len(open(log).read()) == 3


def test_phrases_are_taken_literally(spark):
    from cairn.functions.text import affirmed

    df = spark.createDataFrame([("a c++ (b) finding",), ("no c++ (b) here",), (None,)], "t string")
    assert [r[0] for r in df.select(affirmed(F.col("t"), ["c++ (b)", "a|b"])).collect()][0] is True


RAW = ['{"id":"a","title":"t","evidence_type":"guideline","year":2020,"main_findings":null,"quality":null}', '{"id":"b","title":"t","evidence_type":"guideline","year":2020}', '{"id":"c","title":"t","evidence_type":"guideline","year":2020,"main_findings":"f","quality":"low","extra":"month 7"}', "[1]"]


def test_missing_keys_are_not_nulls(spark):
    from cairn.sources.json_documents import NODE, records_of

    n = records_of(spark.createDataFrame(list(enumerate(RAW)), "k int, t string"), "k", "t", NODE)
    # a missing quality counts as low and so ties with a low one, a null comes after them
    assert [r.id for r in pyramid(n).where("id IS NOT NULL").orderBy("pyramid_rank").collect()] == ["b", "c", "a"]
    edges = spark.createDataFrame([], "_ord bigint, source string, target string, relation string, description string")
    assert sorted((r.row, r.detail) for r in violations(n, edges).where("check = 'missing_field' AND row < 3").collect()) == [(1, "main_findings")]
    hits = retrieve(n.where("_ord < 3"), [Question(1, "null"), Question(2, "month"), Question(3, "nothing at all zz")])
    assert sorted((r.qid, r._ord) for r in hits.collect()) == [(1, 0), (2, 2), (3, 0), (3, 1), (3, 2)]
    assert {r.qid for r in retrieve(n, [Question(1, "null"), Question(3, "zz")], fallback=False).collect()} == {1}
    table = n.drop("_raw").where("_ord < 3")  # in a table a null is a missing value
    assert {r.row for r in violations(table, edges).where("check = 'missing_field'").collect()} == {0, 1}
    assert [r.id for r in pyramid(table).orderBy("pyramid_rank").collect()] == ["a", "b", "c"]


def test_graph_health(spark):
    from cairn.operators.graph import graph_counts
    from cairn.sources.json_documents import NODE, records_of

    n = records_of(spark.createDataFrame([(2, RAW[2])], "k int, t string"), "k", "t", NODE)
    edges = spark.createDataFrame([(0, "c", "c", "r", None), (1, "c", "x", "r", None)], "_ord bigint, source string, target string, relation string, description string")
    assert tuple(graph_counts(n, edges.where("_ord = 0")).first()) == (1, 1, True)
    assert tuple(graph_counts(n, edges).first()) == (1, 2, False)
    assert tuple(graph_counts(n.limit(0), edges.limit(0)).first()) == (0, 0, True)


def test_questions_from_results(spark):
    from cairn.operators.retrieval import result_questions

    df = spark.createDataFrame([(1, ("high", None), ["a b"]), (2, None, None)], "k int, s struct<level:string,other:string>, r array<string>")
    assert [(r.qid, r.text) for r in result_questions(df, "k", ["s", "r"]).orderBy("qid").collect()] == [(1, '[{"level":"high"},["a b"]]'), (2, "[null,null]")]
    kb = spark.createDataFrame([(0, "K", "x", ["level"], "high", None)], "_ord bigint, id string, topic string, tags array<string>, statement string, clinical_use string")
    assert [(r.qid, r.score) for r in knowledge_for_case(kb, result_questions(df, "k", ["s", "r"])).collect()] == [(1, 2)]
