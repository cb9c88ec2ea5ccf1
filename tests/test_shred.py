import json

import pytest

from siltstone.operators import shred

SCHEMA = "locator string, event_uid string, event_json string, value string, kind string"


def frame(spark, *docs):
    return spark.createDataFrame([(None, f"e{i}", d if d is None or isinstance(d, str) else json.dumps(d), "clash", "clash") for i, d in enumerate(docs)], SCHEMA)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_children_of_all_shapes(spark):
    one = {"uid": "a", "prev_event": {"uid": "p", "fingerprint": {"value": "pf"}}, "fingerprint": {"value": "f"}, "signatures": [None, {"digest": {"value": "d"}}, {"algorithm_id": 1}, "text"]}
    docs = [
        {"attestation_list": [None, one]},
        {"attestation_list": {"signatures": {"digest": None}}},
        json.dumps({"attestation_list": [{"fingerprint": {"value": 1.50}}]}),
        json.dumps(json.dumps({"attestation_list": [{"prev_event": {}}]})),
        {"unmapped": {"attestation_list": [one]}}, {"attestation_list": []}, {"attestation_list": None}, None, "", "not json", "[1]", "3",
    ]
    docs[2] = '{"attestation_list": [{"fingerprint": {"value": 1.50}}]}'
    got = rows(shred.attestation_children(frame(spark, *docs)))
    assert got == {
        ("e0", 1, "prev_event", 0, "p"), ("e0", 1, "prev_fingerprint", 0, "pf"), ("e0", 1, "fingerprint", 0, "f"), ("e0", 1, "signature", 1, "d"), ("e0", 1, "signature", 2, ""),
        ("e1", 0, "signature", 0, ""), ("e2", 0, "fingerprint", 0, "1.50"), ("e3", 0, "prev_event", 0, None),
    }


def test_repeated_rows_collapse_and_empty_table(spark):
    df = frame(spark, {"attestation_list": [{"fingerprint": {"value": "x"}}]})
    assert shred.attestation_children(df.union(df)).count() == 1
    assert shred.attestation_children(df.limit(0)).count() == 0


def test_deep_documents_are_read_whole(spark):
    deep = '{"unmapped": ' + '{"x": [' * 30_000 + '"}"' + "]}" * 30_000 + ', "attestation_list": [{"fingerprint": {"value": -1.50e3}}]}'
    got = rows(shred.attestation_children(frame(spark, deep, "[" * 100_000, deep[:-1])))
    assert got == {("e0", 0, "fingerprint", 0, "-1.50e3")}


@pytest.mark.parametrize("text", ["[]", "{}", "[1]", ' {"a": [true, null, {"b": "\\u00e9\\n"}], "c": -0.5e3} ', '"x"', "3", "[1, 2", "[1,]", '{"a" 1}', '{"a": 1,}', "{1: 2}", "[] []", "", "tru", '{"a": }', "[,]", "{,}", ":", '"a\nb"', "01", "[1}"])
def test_the_parser_for_deep_documents_agrees_with_the_usual_one(text):
    written = lambda t: json.loads(t, parse_int=shred._Written, parse_float=shred._Written, parse_constant=shred._Written)
    try:
        want = written(text)
    except ValueError:
        with pytest.raises(ValueError):
            shred._parse_deep(text)
    else:
        assert shred._parse_deep(text) == want


def test_members_named_like_paths_make_no_false_links(spark):
    doc = {"attestation_list": [{"prev_event.fingerprint": {"value": "no"}, "prev_event/fingerprint": {"value": "no"}, "[]": {"value": "no"}, "signatures": {"[]": {"digest": {"value": "no"}}}}], "attestation_list[]": [{"fingerprint": {"value": "no"}}]}
    assert rows(shred.attestation_children(frame(spark, doc))) == {("e0", 0, "signature", 0, "")}
    nested = {"attestation_list": {"[]": {"fingerprint": {"value": "no"}}}}
    assert rows(shred.attestation_children(frame(spark, nested))) == set()


def test_adjacency_keeps_parents_and_ordinals(spark):
    nodes = shred.shred(frame(spark, {"a": [{"b": 1}, {"b": 2}]}), "event_json", "event_uid", "a").collect()
    by = {(tuple(n.path), n.top): n for n in nodes}
    second = by[("a", "[]"), 1]
    assert by[("a", "[]", "b"), 1].above[-1] == second.node and by[("a", "[]", "b"), 1].scalar == "2" and second.ordinal == 1
    assert by[("a",), None].kind == "array" and by[("a",), None].above == [] and second.above == [by[("a",), None].node]
