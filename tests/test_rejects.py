import re

from siltstone.operators import rejects

LAYOUT = {"columns": [("a", "word", False), ("n", "count", False), ("t", "text", True)], "delim": ",", "quote": '"'}
PLAIN = {"columns": [("ip", "ip", False), ("p", "port", True), ("e", "epoch", False), ("s", "stamp", False), ("x", "enum:u|v", False)], "delim": "|", "quote": None}


def brute_quoting(text):
    """A character machine for RFC 4180."""
    state = "start"
    for c in text:
        if state == "start":
            state = "quoted" if c == '"' else "start" if c == "," else "plain"
        elif state == "plain":
            if c == '"':
                return False
            state = "start" if c == "," else "plain"
        elif state == "quoted":
            state = "closed" if c == '"' else "quoted"
        elif c == '"':
            state = "quoted"
        elif c == ",":
            state = "start"
        else:
            return False
    return state != "quoted"


def test_quoting_against_a_machine():
    import itertools

    texts = ["".join(t) for n in range(6) for t in itertools.product('a",', repeat=n)]
    assert len(texts) > 300
    reasons, _, _ = rejects.judge(texts, {"columns": [("x", "text", True)], "delim": ",", "quote": '"'})
    for text, reason in zip(texts, reasons):
        assert (reason == "quoting") == (not brute_quoting(text)), text


def test_reasons_in_order_and_row_numbers():
    texts = ["w,1,x\n", 'w,"1,x', "w,1", "w w,1,x\r\n", '"w","2","a ""b"" \n c"', "", None, "w,9223372036854775808,x", "w,9223372036854775807,-", "w,1,x\x1ey", "w,1,x,y\x1e", "ab,,"]
    reasons, bad, fields = rejects.judge(texts, LAYOUT)
    assert reasons == [None, "quoting", "columns", "value", None, "columns", "columns", "value", None, None, "columns", "value"]
    assert fields[4][2]["text"] == 'a "b" \n c' and fields[8][1]["whole"] == 9223372036854775807 and bad[3] == 0 and fields[9][2]["text"] == "x\x1ey"


def test_kinds():
    ok = "1.2.3.4|80|1.5|2024/02/29 23:59:59|u"
    cases = {ok: None, "01.2.3.4|80|1|2024/01/01 00:00:00|u": "value", "::1|-|1|2024/01/01 00:00:00|v": None, "::1%eth0||1|2024/01/01 00:00:00|v": "value", "1.2.3.4|65536|1|2024/01/01 00:00:00|u": "value",
             "1.2.3.4||1.|2024/01/01 00:00:00|u": "value", "1.2.3.4||1|2023/02/29 00:00:00|u": "value", "1.2.3.4||1|2023/02/28 24:00:00|u": "value", "1.2.3.4||1|2023/02/28 00:00:00|U": "value", '1.2.3.4||1|2023/02/28 00:00:00|"u"': "value"}
    reasons, _, fields = rejects.judge(list(cases), PLAIN)
    assert reasons == list(cases.values())
    assert fields[0][3]["stamp_ns"] == 1709251199_000_000_000 and fields[0][2]["real"] == 1.5


def test_whole_operator(spark):
    layouts = spark.createDataFrame([("p", ",", '"', 0, "a", "word", False), ("p", ",", '"', 1, "n", "count", False)], "pack_id string, delim string, quote_char string, col_no int, col_name string, kind string, is_optional boolean")
    letters = spark.createDataFrame([("l1", "p", "w,1\n", 1), ("l2", "p", "w", 2), ("l2", "p", "w", 2), ("l3", None, "w", 3), ("l4", "q", "w", 4), (None, "p", "x,y", 5)], "locator string, pack string, raw_text string, reason int")
    recent = spark.createDataFrame([("r1", "p", "parsed"), ("r2", None, "parsed"), ("r3", None, "unidentified"), ("r4", "p", "unidentified"), ("r5", "p", None), ("r6", "p", "Parsed")], "locator string, pack string, disposition string")
    got = {tuple(r) for r in rejects.rejects(letters, recent, layouts).collect()}
    assert got == {("l2", "columns"), (None, "value"), ("l4", "layout"), ("r2", "disposition"), ("r4", "disposition"), ("r5", "disposition"), ("r6", "disposition")}
    assert rejects.rejects(letters.limit(0), recent.limit(0), layouts.limit(0)).count() == 0
    more = layouts.union(spark.createDataFrame([(f"p{i}", ",", None, 0, "a", "text", False) for i in range(20)], layouts.schema))
    assert {tuple(r)[:3] for r in rejects.sort_rows(letters, more, layout_rows=4).collect()} == {tuple(r)[:3] for r in rejects.sort_rows(letters, layouts).collect()}
    assert re.match("layout", rejects.sort_rows(letters.where("pack = 'q'"), layouts).head().reason)
