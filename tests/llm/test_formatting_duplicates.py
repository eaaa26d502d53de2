from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm.formatting_duplicates import canonical, collapsed, composed, copies, possible_repeats

SCHEMA = "_ord bigint, title string, citation string, _h string, _n int"


def form(text):
    out, gap = [], False
    for ch in unicodedata.normalize("NFC", text).lower():
        if unicodedata.category(ch)[0] in "LMN":
            if gap and out and out[-1].isdigit() and ch.isdigit():
                out.append(" ")
            out.append(ch)
            gap = False
        else:
            gap = True
    return "".join(out)


def groups(rows):
    by = defaultdict(list)
    for o, t, c, *_ in rows:
        if t is not None and c is not None:
            fields = sorted(f for f in map(form, re.split("[;|；]", c)) if f)
            if form(t) and fields:
                by[form(t), tuple(fields)].append(o)
    return by


def pairs(rows):
    return sorted((min(v), o) for v in groups(rows).values() for o in v if o != min(v))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


WRITTEN = [
    (1, "A Study (4.8 mg)", "J X; 2020; v. 1(2)"), (2, "a study 4．8MG", "v.1(2)|J x|2020|"), (3, "a study 48 mg", "J X; 2020; v. 1(2)"),
    (4, "Étude", "a"), (5, "Etude", "a"), (6, "Étude!", "A;"), (7, "été", "a"), (8, None, "a"), (9, None, "a"), (10, "x", None), (11, "x", ""), (12, "x", ";;"), (13, "x", ";;"),
    (14, "!!", "a"), (15, "!!", "a"), (16, "重症 研究", "甲；乙"), (17, "重症研究", "乙；甲"), (18, "a 1 2", "f;f"), (19, "a1 2", "f;f"), (20, "a12", "f;f"), (21, "a 1-2", "f"), (22, "A​ study 4.8 mg", "2020;J X;v 1 2;;"),
]


def test_written_cases(spark):
    assert sorted(map(tuple, copies(frame(spark, WRITTEN)).collect())) == pairs(WRITTEN)


def test_every_row_stays_in_one_record(spark):
    rows = {r.kept_ord: r.copies for r in collapsed(frame(spark, WRITTEN)).collect()}
    assert sum(rows.values()) == len(WRITTEN)
    assert {k for k, n in rows.items() if n > 1} == {min(v) for v in groups(WRITTEN).values() if len(v) > 1}


@pytest.mark.parametrize("kwargs", [{}, {"filter_bytes": 100}, {"bits_per_row": 1}, {"hot_rows": 20, "salts": 3}])
def test_skewed_copies(spark, kwargs):
    rnd = random.Random(1)
    rows = []
    for i in range(1500):
        t = "Hot Title" if i % 3 == 0 else f"title {rnd.randrange(900)}"
        rows.append((i, rnd.choice([t, t.upper(), t + "."]), rnd.choice(["a;b", "B|a", "b ；A;"])))
    assert sorted(map(tuple, copies(frame(spark, rows), **kwargs).collect())) == pairs(rows)


def test_filter_lets_no_repeat_pass(spark):
    rows = spark.range(20000).selectExpr("id AS _ord", "xxhash64(id % 15000) AS _h")
    got = possible_repeats(rows.repartition(5), 20000)
    flags = {r._ord: r._again for r in got.collect()}
    assert len(flags) == 20000 and all(flags[i] and flags[i + 15000] for i in range(5000))
    assert sum(flags.values()) < 10400  # few of the 10,000 singletons


def test_empty_and_repeated_keys(spark):
    assert copies(frame(spark, [])).collect() == [] and collapsed(frame(spark, [])).collect() == []
    same = [(1, "t", "c"), (1, "t", "c"), (2, "t", "c")]
    assert sorted(map(tuple, copies(frame(spark, same)).collect())) == [(1, 2)]
    assert [tuple(r) for r in collapsed(frame(spark, same)).collect()] == [(1, 3)]


def test_canonical_form(spark):
    texts = ["", " ", "a", "1 2", "12", "a 1b", "1.2.3", "x y  z 9 9", "ÀB", "ÀB", "١ ٢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical(composed(F.col("t"))).alias("c"))
    assert {r.t: r.c for r in df.collect()} == {t: form(t) for t in texts}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_passes_read_their_own_rows_once_each(spark):
    rows = [(i, f"title {i % 700}", "a;b") for i in range(1000)] + [(5000, None, "a"), (5001, "x", ";")]
    df = frame(spark, rows).repartition(3)
    read = []

    def run(**kwargs):
        made = copies(df, **kwargs)
        read.append(plan_of(made))
        return sorted(map(tuple, made.collect()))

    assert run(filter_bytes=300) == run() == pairs(rows)
    # the filters of the passes are gone: what the result joins are the list of hot groups, on both sides
    assert all(p.count("BroadcastExchange") <= 2 for p in read) and "passes-" not in read[0]
    found = {r.kept_ord: r.copies for r in collapsed(df, filter_bytes=300).collect()}
    assert found == {r.kept_ord: r.copies for r in collapsed(df).collect()} and sum(found.values()) == len(rows)


def test_passes_test_each_row_once(spark):
    rows = spark.range(4000).selectExpr("id AS _ord", "xxhash64(id % 3000) AS _h", "'t' AS _title", "'f' AS _fields")
    got = possible_repeats(rows, 4000, filter_bytes=1500)
    flags = got.select("_ord", "_again", "_title").collect()
    assert len(flags) == 4000 and sum(r._again for r in flags) < 2400
    assert {r._ord for r in flags if r._again} >= {*range(1000), *range(3000, 4000)}
    assert all((r._title is None) == (not r._again) for r in flags)
