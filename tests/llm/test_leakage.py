import random

import pytest

from siltstone.llm import leakage

ITEMS = "item_id long, text string, doc_id int"
DOCS = "doc_id long, text string, item_id int"


def brute(docs, items, n=10):
    out = set()
    for d, text, *_ in docs:
        words = leakage.words_of(text)
        for i, item, *_ in items:
            other = leakage.words_of(item)
            if any(words[a : a + n] == other[b : b + n] for a in range(len(words) - n + 1) for b in range(len(other) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(leakage, "MAX_NGRAMS", bound)
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "Beta", "g­amma", "del​ta", "ﬁve", "ÄÖ", "x1", "七"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 25))), 0) for i in range(8)] + [(90, None, 0), (91, "", 0)]
    docs = [(100 + i, ", ".join(word() for _ in range(20)) + "\n" + rng.choice(items[:8])[1].upper().replace(" ", rng.choice([" ", "--", "\t"])) + " tail", 0) for i in range(30)] + [(1, None, 0), (2, " ", 0), (3, "short text", 0)]
    got = [tuple(r) for r in leakage.leaks(spark.createDataFrame(docs + docs[:3], DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    assert set(got) == brute(docs, items) and len(got) == len(set(got)) and got


def test_spans_and_scrubbing(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"a b {item} c", 0), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8", 0), (3, None, 0)], DOCS)
    items = spark.createDataFrame([(7, item, 0)], ITEMS)
    assert [tuple(r) for r in leakage.leaked_spans(docs, items).collect()] == [(1, 7, 2, 17)]
    assert {r.doc_id for r in leakage.scrub(docs, items).collect()} == {2, 3}
    assert leakage.leaks(docs, items.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0


def test_spans_by_join_are_those_by_broadcast(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    words = item.split()
    near = " ".join(words[:12] + words[2:14] + ["x"] + words[18:30] + words[:10])
    docs = spark.createDataFrame([(1, f"a {item} c {item}", 0), (2, near, 0), (3, None, 0), (4, " ".join(words[5:16]), 0)], DOCS)
    items = spark.createDataFrame([(7, item, 0), (8, " ".join(words[3:20]), 0), (9, "", 0)], ITEMS)
    want = sorted(tuple(r) for r in leakage.leaked_spans(docs, items).collect())
    monkeypatch.setattr(leakage, "MAX_NGRAMS", 3)
    got = leakage.leaked_spans(docs, items)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 5
    assert got.dtypes == [("doc_id", "bigint"), ("item_id", "bigint"), ("from_word", "int"), ("to_word", "int")]


def test_passages_are_cut_out_of_the_text(spark):
    item = "One two three four five six seven eight nine ten eleven."
    texts = [f"Before it. {item} After it.", "Ｏne\u200b two, THREE four\u00ad five—six (seven) eight nine ten! Rest.", "nothing of it", None, "", item, "ﬁrst " + item[:-1].replace("o", "o\u0323") + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in leakage.scrub_passages(docs, items).collect()}
    assert got == {0: ("Before it. . After it.", 11), 1: ("! Rest.", 10), 2: ("nothing of it", 0), 3: (None, 0), 4: ("", 0), 5: (".", 11), 6: (texts[6], 0)}
    left = spark.createDataFrame([(k, v[0]) for k, v in got.items()], "doc_id long, text string")
    assert leakage.leaks(left, items).count() == 0 and leakage.scrub_passages(docs.limit(0), items).count() == 0
    assert leakage.word_places("a\u0301b c") == [(0, 3), (4, 5)]
