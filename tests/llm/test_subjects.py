from __future__ import annotations

import random

from cairn.llm.subjects import fit_subjects, page_sentences, sentence_words, subject_areas

DOCS = "doc_id bigint, page_id bigint, text string, subject string"
EXAMPLES = "example_id bigint, subject string, text string"
NOUNS = {
    "law": ["court", "judge", "verdict", "appeal", "witness", "statute", "plaintiff", "clause", "counsel", "hearing"],
    "sport": ["striker", "league", "coach", "penalty", "trophy", "stadium", "referee", "squad", "relay", "wicket"],
    "music": ["violin", "chord", "opera", "choir", "tempo", "melody", "sonata", "album", "rhythm", "cello"],
}
SKELETONS = ["In 1990 the {a} reached {b} before anyone noticed.", "Critics said that every {a} needs a {b} and rarely a plan.", "Most accounts link the {a} with a {b} nearby.", "Only few examples of the {a} survive near the {b} of old."]
FILLERS = ["This section was last checked in 2011.", "See the talk page for older versions of it.", "Some sources give another spelling here."]


def sentence(rnd, subject, known=10):
    a, b = rnd.sample(NOUNS[subject][:known], 2)
    return rnd.choice(SKELETONS).format(a=a, b=b)


def corpus(n=240):
    rnd = random.Random(6)
    docs, truth = [], {}
    for i in range(n):
        main, other = rnd.sample(list(NOUNS), 2)
        share = rnd.choice([0, 0, 1, 4])
        subjects = [main] * (10 - share) + [other] * share
        lines = [sentence(rnd, s) for s in subjects] + rnd.sample(FILLERS, 2)
        rnd.shuffle(lines)
        docs.append((i, i, "'''Page'''\n== Part ==\n" + " ".join(lines) + "\n[[Category:Court]]", "x"))
        truth[i] = {main} | ({other} if share >= 2.5 else set())
    return docs, truth


def examples():
    rnd = random.Random(2)
    rows = [(i, rnd.choice([s, s.upper() + " ", " " + s]), " ".join(sentence(rnd, s, 6) for _ in range(2))) for i, s in enumerate(list(NOUNS) * 8)]
    return [*rows, (900, None, "This is about nothing at all."), (901, "  ", "Nor is this about it."), (902, "law", None)]


def test_subjects_of_pages(spark):
    docs, truth = corpus()
    extra = [(1000, 1000, None, "x"), (1001, 1001, "", "x"), (1002, 1002, " ".join(FILLERS), "x"), (1003, 3, docs[3][2], "x"), (1004, None, docs[4][2], "x")]
    df = spark.createDataFrame(docs + extra, DOCS).repartition(3)
    got: dict[int, set] = {}
    for r in subject_areas(df, spark.createDataFrame(examples(), EXAMPLES)).collect():
        assert r.subject not in got.setdefault(r.doc_id, set())
        got[r.doc_id].add(r.subject)
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.95 * len(truth)
    assert not {1000, 1001, 1002} & set(got)
    assert got[1003] == got[3] and got[1004] == got[4]


def test_fit_is_repeatable_and_holds_out(spark):
    docs, _ = corpus(60)
    df, ex = spark.createDataFrame(docs, DOCS), spark.createDataFrame(examples(), EXAMPLES)
    a, b = fit_subjects(ex, df.repartition(2)), fit_subjects(ex, df.repartition(5))
    assert a.subjects == sorted(NOUNS) and (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_without_labels_or_pages(spark):
    none = spark.createDataFrame([(1, None, "x")], EXAMPLES)
    docs = spark.createDataFrame([(1, 1, "some text that is long enough.", "x")], DOCS)
    assert subject_areas(docs, none).collect() == []
    assert subject_areas(spark.createDataFrame([], DOCS), spark.createDataFrame(examples(), EXAMPLES)).collect() == []


def test_sentences():
    text = "== Head ==\nThe first one is here. Th3 sec0nd 0ne is too!\n\n== Next ==\nShort one.\n* a list item that is long"
    assert [(s, len(w)) for s, w in page_sentences(text)] == [(1, 5), (1, 5), (2, 6)]
    assert page_sentences("#REDIRECT [[Court of law#The judge of it]]") == page_sentences(None) == []
    assert sentence_words("c0urt 1999 B52") == ["court", "bs2"]
