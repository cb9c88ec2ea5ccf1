import random

import pytest

from siltstone.llm import truncation

ENDS = truncation.Endings()


@pytest.mark.parametrize("text,want", [
    ("A full sentence.", "terminal"), ('He said "yes."', "terminal"), ("全部。", "terminal"), ("stops in the mid", "open"), ("this long line stops within a sentence and ha", "open"), ("", "blank"), (" \n", "blank"), (None, "blank"),
    ("cut in transfer bec%C3", "damage"), ("cut in a character �", "damage"), ("an escape \\u00", "damage"), ("an entity caf&eac", "damage"), ("load is 95%", "open"), ("R&D", "open"), ("goes on…", "omission"), ('"goes on..."', "omission"), ("- a table (b[1])", "closed"), ("- a table) (b", "open"), ("- a) \"b", "open"), ("x" * 100_000, "open"),
])
def test_endings(text, want):
    assert ENDS.classify(text)[0] == want


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(6, 12))).capitalize() + "."
    docs, cut = [], set()
    for i in range(400):
        text = " ".join(sentence() for _ in range(rng.randrange(1, 12)))
        if i % 5 == 0:
            text += "\n- rotate the table\n- drain the clock"
        source = "limited" if i % 2 else "open"
        if source == "limited" and len(text) > 300:
            text = text[:300]
            if not text.rstrip().endswith(".") and not text.endswith("clock"):
                cut.add(i)
        docs.append((i, text, source))
    docs.append((1000, "Some marked text goes on like th [truncated]".rjust(300, "x"), "limited"))
    cut.add(1000)
    docs += [(1001 + k, f"Part {k} of it. To be continued...", "open") for k in range(5)]
    return docs + [(2000, None, None), (2001, "", "open"), (2002, "  ", "open")], cut


def test_limits_and_cut_texts(spark):
    docs, cut = corpus()
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, source string, at_limit int, kind string")
    spikes = {(r.source, r.length) for r in truncation.limits(truncation.lengths(df)).collect()}
    assert spikes == {("limited", 300)}
    got = {r.doc_id for r in truncation.found(df).collect()}
    assert got == cut
    rate = {r.source: r for r in truncation.rates(df).collect()}
    assert rate["open"].n_cut == 0 and rate["limited"].n_cut == len(cut) == rate["limited"].n_cut_at_limit
    assert truncation.found(df.limit(0)).count() == 0


LINED = "rotate the {} table\n- drain the {} clock\nThe clock of group {} was drained before the table of group {} was rotated."


def test_copies_do_not_vouch_for_a_cut_text(spark):
    docs = [(i, "- " + LINED.format(i, i, i, i), "open") for i in range(40)]
    docs += [(100 + k, "Some of it is left.\n- drain the clo", "open" if k % 2 else "other") for k in range(9)]
    docs += [(200 + i, f"Report {i} is complete.\n-- B team", "open") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert {r.doc_id for r in truncation.found(df).collect()} == set(range(100, 109))


def test_verdict_does_not_move_with_size(spark):
    """A fragment that recurs in proportion to the texts stays cut, an ending at which lines stop stays complete."""
    for times in (1, 10):
        docs = []
        for i in range(400 * times):
            name = "abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10]
            docs.append(f"Entry {i} was read.\n> 2026-01-{i % 28 + 1:02d} {name} started\n> 2026-02-03 {name} stopped\nIt was entry {i} again.")
        docs += [f"Entry {i} of all.\n> {cut}" for i in range(times) for cut in ("2", "20", "202")]
        docs += [f"Entry {i} of all.\n> 2026-03-04 aa stopped" for i in range(3 * times)]
        df = spark.createDataFrame([(i, t, "open") for i, t in enumerate(docs)], "doc_id long, text string, source string")
        assert sorted(r.doc_id for r in truncation.found(df).collect()) == list(range(400 * times, 403 * times))


def test_endings_in_passes(spark, monkeypatch):
    docs, cut = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    monkeypatch.setattr(truncation, "KEYS_SIZE", 500)
    assert {r.doc_id for r in truncation.found(df).collect()} == cut


def test_running_text_of_a_source_without_full_stops(spark):
    """Lines of prose without punctuation are no cuts where a source writes so, at whatever length; elsewhere the same lines are."""
    rng = random.Random(4)
    line = lambda: "The " + " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(6, 14)))
    docs = [(i, line(), "bare") for i in range(300)] + [(300 + i, line() + ".", "full") for i in range(300)] + [(600 + i, line(), "full") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert {r.doc_id for r in truncation.found(df).collect()} == set(range(600, 605))


def test_at_a_limit_terminal_punctuation_alone_is_complete(spark):
    rng = random.Random(6)
    fill = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    docs = [(i, fill(40 + i) + ".", "s") for i in range(160)]
    docs += [(1000 + i, fill(300 - len(end)) + end, "s") for i, end in enumerate([" wor", " [truncated]", " more…", " on ...", " (b)", ".", "。", '."', " 12", "!"])]
    docs += [(2000 + i, "é" * 99 + fill(99) + "x", "t") for i in range(5)] + [(2100 + i, fill(20 + i) + ".", "t") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = {tuple(r)[:4] for r in truncation.limits(truncation.lengths(df)).collect()}
    assert found == {("s", "text", "chars", 300), ("s", "text", "bytes", 300), ("t", "text", "chars", 199), ("t", "text", "bytes", 298)}
    assert {r.doc_id for r in truncation.found(df).collect()} == {1000, 1001, 1002, 1003, 1004, 1008, *range(2000, 2005)}
    of_s = {r.source: r for r in truncation.at_limits(df).collect()}["s"]
    assert (of_s.n_texts, of_s.n_at_limit, of_s.n_cut_at_limit) == (170, 10, 6)
