from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import cairn.llm.term_counts as term_counts_module
from cairn.llm.term_counts import term_counts

SCHEMA = "tags array<string>, term string, id bigint"


def brute(lists):
    occurrences, records = Counter(), Counter()
    for tags in lists:
        terms = [t.strip().lower() for t in tags or [] if t is not None and t.strip()]
        occurrences.update(terms)
        records.update(set(terms))
    n = len(lists)
    return {t: (occurrences[t], records[t], "rare" if records[t] < 3 else "common" if records[t] > n / 20 else None) for t in occurrences}


def run(spark, lists, other=()):
    frames = [(spark.createDataFrame([(x, "z", 1) for x in part], SCHEMA), "tags") for part in (lists, other)]
    rows = term_counts(frames).collect()
    assert sorted(r.id for r in rows) == list(range(len(rows)))
    return {r.term: (r.occurrences, r.records, r.mark) for r in rows}


def test_written_cases(spark):
    lists = [["A", "a ", "\ta", "　a\xa0"], None, [], [None, "", "  "], ["b c", "B C"], ["​x"], ["É", "é"], ["x\x1c", "x"]]
    assert run(spark, lists, [["a"], ["b  c"]]) == brute([*lists, ["a"], ["b  c"]])


def test_skewed_terms_over_ranges(spark, monkeypatch):
    rnd = random.Random(2)
    lists = [[rnd.choice(["hot", "HOT ", f"t{rnd.randrange(300)}", None]) for _ in range(rnd.randrange(6))] for _ in range(1000)]
    assert run(spark, lists) == brute(lists)


def test_long_list_and_empty_tables(spark):
    assert run(spark, [], []) == {}
    lists = [[f"t{i % 1000}" for i in range(20000)]]
    assert run(spark, lists) == brute(lists)


def test_small_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    lists = [[f"t{rnd.randrange(400)}" for _ in range(rnd.randrange(9))] for _ in range(600)]
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[a : a + 50])], names=["t"]) for a in range(0, 600, 50)]
    monkeypatch.setattr(term_counts_module, "BLOCK_TERMS", 100)
    table = pa.Table.from_batches(term_counts_module._counted(iter(batches)))
    assert table.num_rows > 400  # several blocks, each with its own entries
    got = {r["term"]: (r["occurrences_sum"], r["records_sum"]) for r in table.group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")]).to_pylist()}
    assert got == {t: (o, r) for t, (o, r, _) in brute(lists).items()}
    assert list(term_counts_module._counted(iter(()))) == []


@pytest.mark.parametrize("held", [100, 10_000])
def test_arrays_over_many_ranges_stay_small(monkeypatch, held):
    monkeypatch.setattr(term_counts_module, "RANGE", 8)
    monkeypatch.setattr(term_counts_module, "HELD_COUNTS", held)
    rnd = np.random.default_rng(0)
    ids = rnd.integers(0, 20_000, 30_000)  # 2,500 ranges
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 100]), pa.array(np.ones(100, int)), pa.array(np.full(100, 2))], names=["id", "o", "r"]) for a in range(0, len(ids), 100)]
    arrays = pa.Table.from_batches(term_counts_module._accumulate(iter(batches)))
    assert arrays.nbytes < 2.5 * sum(b.nbytes for b in batches)
    out = pa.Table.from_batches(term_counts_module._sum(iter(arrays.sort_by("range").to_batches()))).to_pydict()
    want = Counter(ids.tolist())
    assert dict(zip(out["id"], out["occurrences"])) == want
    assert dict(zip(out["id"], out["records"])) == {k: 2 * v for k, v in want.items()}


def test_identifiers_past_many_ranges_of_the_real_size():
    ids = np.random.default_rng(1).integers(0, 100_000_000, 200_000)  # 1,526 ranges
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.ones(len(ids), int)), pa.array(np.ones(len(ids), int))], names=["id", "o", "r"])
    assert pa.Table.from_batches(term_counts_module._accumulate(iter([batch]))).nbytes < 2 * batch.nbytes
