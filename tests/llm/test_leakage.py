from __future__ import annotations

import random

import numpy as np
import pytest

from cairn.llm.leakage import Items, Shard, leaked_items, longest_common, suffix_array, without_leaks
from cairn.llm.wikitext import page_words, plain_words

DOCS = "doc_id bigint, text string, item_id string, lang string"
ITEMS = "item_id bigint, text string, doc_id int"


def brute(docs, items, k):
    out = {}
    for d, t, *_ in docs:
        for i, x, *_ in items:
            w = plain_words(x)
            best = 0
            for part in page_words(t):
                for a in range(len(w)):
                    for b in range(len(part)):
                        n = 0
                        while a + n < len(w) and b + n < len(part) and w[a + n] == part[b + n]:
                            n += 1
                        best = max(best, n)
            if best >= k:
                out[d, i] = best
    return out


@pytest.mark.parametrize("depth", [1, 3, 8, 100])
def test_suffix_array(depth):
    rnd = np.random.default_rng(depth)
    ids = rnd.integers(0, 4, 300).astype(np.int32)
    order = suffix_array(ids, depth)
    cut = [tuple(ids[i : i + depth]) for i in order]
    assert sorted(order) == list(range(300)) and cut == sorted(cut)


@pytest.mark.parametrize("kwargs", [{}, {"shard_words": 40}, {"block_words": 10}])
def test_against_brute_force(spark, kwargs):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcd")
    items = [(i, " ".join(word() for _ in range(rnd.randrange(0, 14))), 1) for i in range(12)] + [(50, None, 1), (51, "", 1), (52, "a b c d a b c d", 1), (53, "A, b; C d a b c D", 1)]
    docs = []
    for d in range(60):
        text = " ".join(word() for _ in range(rnd.randrange(0, 30)))
        if rnd.random() < 0.3:
            text = text.replace(" ", " {{x|y}} ", 1) + " [[t|a b]] ''c'' d<ref>n</ref> a b c d"
        docs.append((d, text, "x", "en"))
    docs += [(100, None, "x", "en"), (101, "", "x", "en"), (102, docs[0][1], "x", "en")]
    got = leaked_items(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), min_words=5, **kwargs).collect()
    assert {(r.doc_id, r.item_id): r.matched_words for r in got} == brute(docs, items, 5)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    for r in got:
        doc = [w for part in page_words(dict((d, t) for d, t, *_ in docs)[r.doc_id]) for w in [*part, None]]
        item = plain_words(dict((i, t) for i, t, _ in items)[r.item_id])
        assert doc[r.doc_word : r.doc_word + r.matched_words] == item[r.item_word : r.item_word + r.matched_words]


def test_passages_in_markup(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    split = passage.split()
    pages = [
        "x " + passage.upper() + " y", " ".join(split[:6]) + " {{cn}} " + " ".join(split[6:]), "{{quote|text=" + passage + "}}", "* " + "\n* ".join(split),
        "{|\n" + "".join(f"|-\n| {a} || {b}\n" for a, b in zip(split[::2], split[1::2])) + "|}", " ".join(f"[[link to|{w}]]" for w in split), "&nbsp;".join(split), "'''" + "''' '''".join(split) + "'''",
        passage.replace("six", "six<ref>note</ref> <!-- c -->"), " ".join(split[:11]), passage.replace("six", "six other"), passage.replace("six", "[[six|6]]"),
    ]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(pages)], DOCS)
    items = spark.createDataFrame([(7, "Before. " + passage + ", after!", 1)], ITEMS)
    leaks = leaked_items(docs, items)
    assert sorted(r.doc_id for r in leaks.collect()) == list(range(9))
    assert sorted(r.doc_id for r in without_leaks(docs, leaks).collect()) == [9, 10, 11]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaked_items(docs, items).collect() == []
    assert leaked_items(docs, spark.createDataFrame([(1, "a " * 20, 1)], ITEMS)).collect() == []
    assert leaked_items(spark.createDataFrame([(1, "a " * 20, "", "")], DOCS), items).collect() == []


def test_long_document_and_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = [(i, passage, "", "") for i in range(300)] + [(999, "z " * 30000 + passage, "", "")]
    got = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, passage, 0), (2, passage, 0)], ITEMS), shard_words=5000).collect()
    assert len(got) == 602 and all(r.matched_words == 14 for r in got)


def longest_slow(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return best


def test_longest_common():
    rnd = np.random.default_rng(4)
    for size in (1, 2, 5, 20, 60):
        for _ in range(20):
            a, b = rnd.integers(0, 3, rnd.integers(1, size + 1)), rnd.integers(0, 3, size)
            assert longest_common(a, b) == longest_slow(a.tolist(), b.tolist())


def test_long_items_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    rnd = np.random.default_rng(2)
    item = [f"w{i}" for i in rnd.integers(0, 50_000, 100_000)]
    shard = Shard()
    shard.add(1, [["x", "y"] * 50, item, ["z"]])
    shard.add(2, [item[500:530]])
    tracemalloc.start()
    got = shard.matches(Items([7], pa.array([item])), 12)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert sorted(got) == [(1, 7, 100_000, 101, 0), (2, 7, 30, 0, 500)]


def test_an_item_of_one_word_repeated():
    import pyarrow as pa

    shard = Shard()
    shard.add(1, [["z"] * 20_000])
    shard.add(2, [["z"] * 11, ["z"] * 13])
    assert sorted(shard.matches(Items([7, 8], pa.array([["z"] * 5_000, ["z"] * 12])), 12)) == [(1, 7, 5_000, 0, 0), (1, 8, 12, 0, 0), (2, 7, 13, 12, 0), (2, 8, 12, 12, 0)]


def test_many_places_in_parts(monkeypatch):
    import pyarrow as pa

    import cairn.llm.leakage as module

    monkeypatch.setattr(module, "OPEN_PLACES", 5)
    rnd = np.random.default_rng(1)
    items = [[f"v{k}" for k in rnd.integers(0, 4, 12)] for _ in range(6)]
    shard = Shard()
    for d in range(40):
        shard.add(d, [[f"v{k}" for k in rnd.integers(0, 4, 25)]])
    want = {}
    for d in range(40):
        words = {v: k for k, v in shard.numbers.items()}
        doc = [words.get(i) for i in shard.ids[d * 26 : d * 26 + 25]]
        for i, item in enumerate(items):
            if (best := longest_slow(doc, item))[0] >= 4:
                want[d, i] = best
    assert {(r[0], r[1]): r[2:] for r in shard.matches(Items(list(range(6)), pa.array(items)), 4)} == want
