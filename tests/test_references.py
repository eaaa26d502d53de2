from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest

from cairn.operators.references import Reference, Validity, orphan_references, orphan_report

CHILD = "k bigint, a string, b string, at timestamp_ntz, note string"
PARENT = "a string, b string, since timestamp_ntz, until timestamp_ntz, k bigint"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def found(df):
    return sorted((r.k, r.reference, r.null_mask) for r in df.collect())


def test_match_semantics_by_null_mask(spark):
    child = spark.createDataFrame([(1, "x", "y", None, None), (2, "x", None, None, None), (3, None, None, None, None), (4, "q", None, None, None), (5, None, "y", None, None), (6, "x", "z", None, None)], CHILD)
    parent = spark.createDataFrame([("x", "y", None, None, 1), (None, "z", None, None, 2)], PARENT)
    for match, wanted in {
        "simple": [(6, "r", "00")],
        "partial": [(4, "r", "01"), (6, "r", "00")],
        "full": [(2, "r", "01"), (4, "r", "01"), (5, "r", "10"), (6, "r", "00")],
    }.items():
        assert found(orphan_references(child, parent, [Reference("r", ("a", "b"), ("a", "b"), match)], ["k"])) == wanted


def test_validity_against_brute_force(spark):
    rnd = random.Random(5)
    parents = [(rnd.choice("pqrs"), None, day(rnd.choice([None, *range(40)])), day(rnd.choice([None, None, *range(60)])), i) for i in range(60)]
    children = [(i, rnd.choice("pqrstu"), rnd.choice(["p", "q", None]), day(rnd.choice([None, *range(70)])), "x") for i in range(300)]
    got = found(orphan_references(spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT), [Reference("a", ("a",), ("a",)), Reference("b", ("b",), ("a",))], ["k"], validity=Validity("at", "since", "until")))
    wanted = []
    for k, a, b, at, _ in children:
        for name, value in (("a", a), ("b", b)):
            if value is not None and not any(p[0] == value and at and p[2] and p[2] <= at and (p[3] is None or p[3] > at) for p in parents):
                wanted.append((k, name, "0"))
    assert got == sorted(wanted)


def test_empty_tables_and_repeats(spark):
    no_parent = spark.createDataFrame([], PARENT)
    child = spark.createDataFrame([(1, "x", None, day(1), None), (1, "x", None, day(1), None)], CHILD)
    ref = [Reference("a", ("a",), ("a",))]
    assert found(orphan_references(child, no_parent, ref, ["k"])) == [(1, "a", "0")] * 2
    assert found(orphan_references(spark.createDataFrame([], CHILD), no_parent, ref, ["k"])) == []
    assert found(orphan_references(child, no_parent, [], ["k"])) == []


def test_hot_reference(spark):
    child = spark.range(5000).selectExpr("id AS k", "IF(id % 3 = 0, 'hot', concat('c', id % 50)) AS a")
    parent = spark.createDataFrame([("hot",), ("c1",), ("c1",)], "a string")
    got = orphan_references(child, parent, [Reference("a", ("a",), ("a",))], ["k"]).count()
    assert got == sum(1 for i in range(5000) if i % 3 and i % 50 != 1)


def test_report_counts_by_period(spark):
    child = spark.createDataFrame([(1, "x", None, day(1), None), (2, "y", None, day(40), None), (3, "z", None, day(41), None), (4, "z", None, None, None)], CHILD)
    orphans = orphan_references(child, spark.createDataFrame([], PARENT), [Reference("a", ("a",), ("a",))], ["k"], ["at"])
    assert sorted((r.period or "", r.orphans) for r in orphan_report(orphans, "t", "at").collect()) == [("", 1), ("2024-01", 1), ("2024-02", 2)]


def test_declarations_are_checked():
    with pytest.raises(ValueError):
        Reference("r", ("a",), ("a", "b"))
    with pytest.raises(ValueError):
        Reference("r", ("a",), ("a",), "loose")
    for match, width in itertools.product(("simple", "partial", "full"), (1, 2)):
        assert Reference("r", ("a",) * width, ("a",) * width, match).match == match


def test_partition_of_a_hot_reference_is_split(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        child = spark.range(0, 60000, 1, 8).selectExpr("id AS k", "IF(id % 3 = 0, 'hot', concat('c', id)) AS a", "timestamp_ntz'2024-01-05' AS at")
        parent = spark.createDataFrame([("hot", None, day(0), None, 1)], PARENT)
        got = orphan_references(child, parent, [Reference("a", ("a",), ("a",))], ["k"], validity=Validity("at", "since", "until"))
        assert len(got.collect()) == 40000
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_causes(spark):
    from cairn.operators.references import orphan_causes

    day = lambda n: None if n is None else dt.datetime(2024, 1, n + 1)
    parent = spark.createDataFrame([(i, day(x), day(y)) for i, x, y in [("a", 5, None), ("b", 1, 3), ("b", 9, None), ("c", None, None)]], "id string, s timestamp_ntz, e timestamp_ntz")
    child = spark.createDataFrame([(k, r, day(n)) for k, r, n in [(1, "a", 4), (2, "a", 5), (3, "b", 4), (4, "b", 0), (5, "c", 4), (6, "x", 4), (7, "a", None), (8, None, 4)]], "k int, ref string, at timestamp_ntz")
    refs, validity = [Reference("r", ("ref",), ("id",))], Validity("at", "s", "e")
    orphans = orphan_references(child, parent, refs, ["k"], ["ref", "at"], validity)
    got = {r.k: r.cause for r in orphan_causes(orphans, parent, refs, validity).collect()}
    assert got == {1: "late", 3: "deleted", 4: "late", 5: "missing", 6: "missing", 7: "untimed"}
