from __future__ import annotations

import math
import random

import pytest

from cairn.operators.hotdeck import Usable, fill_table, hot_deck

SCHEMA = "k bigint, g string, e string, at double, labs struct<v:double,w:double>, _v0 string, field_name string"
FIELDS = {"v": Usable("labs.v", 0, 100, low_open=True), "w": Usable("labs.w", 1, 50)}


def usable(field, x):
    if x is None or math.isnan(x):
        return None
    return x if (0 < x <= 100 if field == "v" else 1 <= x <= 50) else None


def brute(rows):
    out = {}
    for f, pick in (("v", 0), ("w", 1)):
        for g in {r[1] for r in rows if r[1] is not None}:
            mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[3] is not None, r[3] or 0, r[0]))
            value = [usable(f, r[4][pick] if r[4] else None) for r in mine]
            same = lambda a, b: a[2] is not None and a[2] == b[2] or a[0] == b[0]
            for i, r in enumerate(mine):
                if value[i] is not None:
                    continue
                before = next((j for j in range(i - 1, -1, -1) if value[j] is not None and not same(mine[j], r)), None)
                after = next((j for j in range(i + 1, len(mine)) if value[j] is not None and not same(mine[j], r)), None)
                far = lambda j: math.inf if j is None or r[3] is None or mine[j][3] is None else abs(mine[j][3] - r[3])
                if before is None and after is None:
                    continue
                j = before if before is not None and (after is None or far(before) <= far(after)) else after
                d = far(j)
                out[(r[0], f)] = (value[j], mine[j][0], "previous" if j == before else "next", None if d == math.inf else d)
    return out


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_against_brute_force(spark, partitions):
    rnd = random.Random(partitions)
    number = lambda: rnd.choice([None, None, math.nan, -1.0, 0.0, 999.0, round(rnd.uniform(1, 50), 1)])
    rows = []
    for k in range(400):
        g = "hot" if rnd.random() < 0.4 else rnd.choice([None, "a", "b", "c", "lone%d" % k])
        rows.append((k, g, rnd.choice([None, f"e{k}", f"e{rnd.randrange(400)}", "same"]), rnd.choice([None, float(rnd.randrange(30))]), rnd.choice([None, (number(), number()), (number(), number())]), "x", "y"))
    got = hot_deck(spark.createDataFrame(rows, SCHEMA), "k", "g", "e", FIELDS, ["at"], partitions=partitions)
    assert {(r.k, r.field_name): (r.filled, r.donor, r.side, r.distance) for r in got.collect()} == brute(rows)


def test_redelivered_case_is_no_donor(spark):
    rows = [(1, "g", "a", 1.0, (None, 5.0), "", ""), (2, "g", "a", 2.0, (7.0, 5.0), "", "")]
    assert hot_deck(spark.createDataFrame(rows, SCHEMA), "k", "g", "e", FIELDS, ["at"]).collect() == []


def test_empty_and_marks(spark):
    assert hot_deck(spark.createDataFrame([], SCHEMA), "k", "g", "e", FIELDS, ["at"]).collect() == []
    df = spark.createDataFrame([(1, "g", "a", 1.0, (None, 5.0), "", ""), (2, "g", "b", 2.0, (7.0, 600.0), "", ""), (3, None, "c", 2.0, None, "", "")], SCHEMA)
    rows = {r.k: r for r in fill_table(df, hot_deck(df, "k", "g", "e", FIELDS, ["at"]), "k", FIELDS).collect()}
    assert (rows[1].v, rows[1].v_filled, rows[1].w, rows[1].w_filled) == (7.0, True, 5.0, False)
    assert (rows[2].v, rows[2].v_filled, rows[2].w, rows[2].w_filled) == (7.0, False, 5.0, True)
    assert (rows[3].v, rows[3].v_filled) == (None, False)


def test_categorical_fields(spark):
    from cairn.operators.hotdeck import Category

    rows = [(1, "g", "a", 1, " Good "), (2, "g", "b", 2, None), (3, "g", "c", 5, "poor"), (4, "g", "d", 4, ""), (5, "g", "e", 9, "other"), (6, "h", "f", 1, None), (7, None, "i", 1, None)]
    df = spark.createDataFrame(rows, "k int, g string, e string, t int, v string")
    fills = hot_deck(df, "k", "g", "e", {"v": Category("v", ("good", "poor"))}, ["t"])
    assert sorted((r.k, r.filled, r.donor, r.side, r.distance) for r in fills.collect()) == [(2, "good", 1, "previous", 1.0), (4, "poor", 3, "next", 1.0), (5, "poor", 3, "previous", 4.0)]
    both = {"v": Category("v", ("good", "poor")), "t": Usable("t", 0, 4)}
    mixed = hot_deck(df, "k", "g", "e", both, ["t"])
    assert {(r.k, r.field_name): r.filled for r in mixed.collect()}[3, "t"] == "4.0"
    table = {r.k: r for r in fill_table(df, mixed, "k", both).collect()}
    assert (table[3].t, table[3].t_filled, table[5].v, table[5].v_filled, table[6].v) == (4.0, True, "poor", True, None)
