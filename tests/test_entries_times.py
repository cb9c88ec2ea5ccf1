from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from siltstone.operators import entries, loglines, timestamps

RAW = "raw_id long, locator string, event_uid string, raw binary, received_at long, peer string, transport string, receiver_id string, origin string, text string"


def raw(spark, *rows):
    return spark.createDataFrame([(i, f"l{i}", e, None if b is None else bytearray(b), t, p, None, None, o, "clash") for i, e, b, t, p, o in rows], RAW)


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_assembly_in_blocks_of_any_width(spark, block):
    rows = [(0, None, b"orphan\n", 1, "a", None), (1, "e1", b"one\n", 1, "a", None), (2, "e2", b"two", 1, "b", None), (3, None, b"more\r\n\n", 1, "a", None), (4, None, b"", 1, "b", None), (9, None, b"last", 1, "a", None), (10, "e1", None, 1, "a", None), (11, "e3", b"\xff\n", 1, None, None)]
    got = {r.raw_id: (r.event_uid, r.text, r.n_lines) for r in entries.assemble(raw(spark, *rows), block).collect()}
    assert got == {0: (None, "orphan\n", 1), 1: ("e1", "one\nmore\r\n\nlast", 4), 2: ("e2", "two\n", 2), 10: ("e1", "", 1), 11: ("e3", "�\n", 1)}


def ns(*parts, nanos=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 10**9 + nanos


CASES = [
    ("<34>1 2025-10-11T13:18:19.559+02:00 h app - - - x", "Asia/Tokyo", 0, ns(2025, 10, 11, 11, 18, 19, nanos=559_000_000)),
    ("<34>Oct 11 01:02:03 h app: x", "Europe/Berlin", ns(2025, 10, 11), ns(2025, 10, 10, 23, 2, 3)),
    ("Dec 31 23:59:59 h app: x", None, ns(2026, 1, 1), ns(2025, 12, 31, 23, 59, 59)),
    ("Jan  1 00:00:01 h app: x", None, ns(2025, 12, 31, 23), ns(2026, 1, 1, 0, 0, 1)),
    ("<34>Nov 07 2025 19:49:15 h app: x", "Asia/Kolkata", 0, ns(2025, 11, 7, 14, 19, 15)),
    ("[Sun Oct 26 02:30:00.5 2025] [core:info] x", "Europe/Berlin", ns(2025, 10, 26, 0, 31), ns(2025, 10, 26, 0, 30, nanos=500_000_000)),
    ("[Sun Oct 26 02:30:00 2025] [core:info] x", "Europe/Berlin", ns(2025, 10, 26, 2), ns(2025, 10, 26, 1, 30)),
    ("2025-04-06 01:45:00,123 INFO a: x", "Australia/Lord_Howe", ns(2025, 4, 5, 16), ns(2025, 4, 5, 15, 15, nanos=123_000_000)),
    ("Sun Oct 12 04:54:34 EDT 2025 p(INFO): x", "Asia/Tokyo", 0, ns(2025, 10, 12, 8, 54, 34)),
    ('1.2.3.4 - - [19/Oct/2025:17:53:02 +1100] "GET / HTTP/1.1" 200 1', None, 0, ns(2025, 10, 19, 6, 53, 2)),
    ('level=warn time="2025-10-11T10:26-0500" msg="x"', None, 0, ns(2025, 10, 11, 15, 26)),
    ("D1016 08:41:01.134517   75769 intake.go:19] x", "UTC", ns(2025, 10, 16), ns(2025, 10, 16, 8, 41, 1, nanos=134_517_000)),
    ("02-29 00:00:00.000  1  2 I T: x", None, ns(2024, 3, 1), ns(2024, 2, 29)),
    ("1760417565.160 notice a - x", "Asia/Tokyo", 0, 1760417565_160_000_000),
    ('{"v": 1, "@timestamp": 1763122597269891, "m": "x"}', None, 0, 1763122597269891_000),
    ('{"a": "time", "time": "2025-10-29T08:03:09.552+0900"}', None, 0, ns(2025, 10, 28, 23, 3, 9, nanos=552_000_000)),
    ("Oct 26, 2025 12:27:37 AM a.b c\nINFO: x", "UTC", 0, ns(2025, 10, 26, 0, 27, 37)),
    ("25/10/28 12:01:42 INFO A: x", "UTC", 0, ns(2025, 10, 28, 12, 1, 42)),
    ("05.11.2025 22:51:29.68 | ERROR | k | x", "UTC", 0, ns(2025, 11, 5, 22, 51, 29, nanos=680_000_000)),
    ('{"v": 2, "@timestamp": "20251013T120700Z", "m": "x"}', "Asia/Tokyo", 0, ns(2025, 10, 13, 12, 7)),
    ('{"ctx": {"a": [1, {"b": "}"}], "time": 5}, "k": [], "time": "20251013T120700.25+0900"}', None, 0, ns(2025, 10, 13, 3, 7, nanos=250_000_000)),
    ("20251013T120700 INFO x", "Asia/Tokyo", 0, ns(2025, 10, 13, 3, 7)), ("20251013120700 x", "UTC", 0, None), ("251013 120700 148 INFO x", "UTC", 0, ns(2025, 10, 13, 12, 7)),
    ('level=a msg="time=2020-01-01T00:00Z \\" x" ts=20251013T120700Z', None, 0, ns(2025, 10, 13, 12, 7)), ("a=1 b= ts=- time=1760000000.5 c=d", None, 0, 1760000000_500_000_000),
    ("Sun Oct 12 04:54:34 +11 2025 p(INFO): x", "Asia/Tokyo", 0, ns(2025, 10, 11, 17, 54, 34)), ("Sun, 12 Oct 2025 04:54:34 -0130 x", "Asia/Tokyo", 0, ns(2025, 10, 12, 6, 24, 34)),
    ("2025-02-30 00:00:00 x", "UTC", 0, None),
    ("2025-03-30 02:30:00 gap", "Europe/Berlin", 0, ns(2025, 3, 30, 1, 30)),
    ("[INFO ] lease - x", "UTC", 0, None), ("", "UTC", 0, None), (None, "UTC", 0, None), ("no 2025-01-01 head", "UTC", 0, None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, t, z, r) for i, (t, z, r, _) in enumerate(CASES)], "i int, text string, zone string, received_at long")
    got = {r.i: r.stated_ns for r in timestamps.stated_instant(df, "text", "received_at", "zone").collect()}
    assert got == {i: want for i, (*_, want) in enumerate(CASES)}


def test_long_lines_are_read_once(spark):
    """Hundreds of pairs without a time key, and lines of a megabyte, in time that grows with their length only."""
    import time

    pair, member = 'k="a b \\" c" ', '"k": "a \\" b", '
    texts = [pair * 200 + "end", pair * 200 + "time=x", "{" + member * 200 + '"z": 1}', "{" + member * 200, pair * 80_000, "{" + member * 70_000, "{" + member * 70_000 + '"time": "20251013T120700Z"}', "x" * 1_000_000, "a=" * 500_000, '{"a": ' * 100_000, "[" * 1_000_000, '"' * 1_000_000, pair * 80_000 + "ts=2025-10-13T12:07Z"]
    df = spark.createDataFrame([(i, t, "UTC", 0) for i, t in enumerate(texts)], "i int, text string, zone string, received_at long")
    began = time.time()
    got = {r.i: r.stated_ns for r in timestamps.stated_instant(df, "text", "received_at", "zone").collect() if r.stated_ns is not None}
    assert got == {6: ns(2025, 10, 13, 12, 7), 12: ns(2025, 10, 13, 12, 7)}
    assert time.time() - began < 60


def test_receipts_of_any_precision(spark):
    df = spark.createDataFrame([(1760000000,), (1760000000123,), (1760000000123456,), (1760000000123456789,), (None,)], "r long")
    assert [x[0] for x in df.select(timestamps.receipt_ns(F.col("r"))).collect()] == [1760000000 * 10**9, 1760000000123 * 10**6, 1760000000123456 * 10**3, 1760000000123456789, None]


def test_wrong_instants(spark):
    records = raw(spark, (1, "e1", b"2025-01-01 00:00:00 x\n", 1, "p", None), (2, "e1", b"2026-01-01 00:00:00 x\n", 1, "p", None), (3, "e2", b"{\n", 1, None, "o"), (4, None, b'"time": 1760000000}\n', 1, None, "o"), (5, "e3", b"none", 1, "z", None))
    devices = spark.createDataFrame([(1, "p", None, "Asia/Tokyo"), (2, None, "o", "No/Where"), (3, None, None, None)], "device_id int, peer_ip string, origin_path string, zone_name string")
    features = spark.createDataFrame([("e1", 5), ("e1", 5), ("e2", 1760000000 * 10**9), ("e3", -1), ("e9", 1)], "event_uid string, time_ns long")
    got = [tuple(r) for r in timestamps.wrong_instants(records, devices, features).collect()]
    assert got == [("e1", ns(2024, 12, 31, 15))]


LINES = [
    ("<189>1 2025-10-11T13:18:19.559+02:00 h mapper 46 ID46 [meta level=\"warn\"] x", "INFO", "mapper"),
    ("<8>Oct 11 20:20:41 bs-02 packctl[20625]: error", "FATAL", "packctl"), ("Oct 11 20:20:41 bs-02 kernel: x", "", "kernel"), ("<30>1 2025-10-11T13:18:19Z h - - - - x", "INFO", ""),
    ("[Sun Oct 12 05:20:39 2025] [mpm_pool:crit] [pid 1:tid 2] x", "FATAL", "mpm_pool"), ('1.2.3.4 - bob [19/Oct/2025:17:53:02 +1100] "GET /error HTTP/1.1" 500 1', "", ""),
    ('time="2025/10/24 10:11:22" level=error component=ledger msg="a level=info b"', "ERROR", "ledger"), ("Sun Oct 12 04:54:34 EDT 2025 exporter(INFO): x", "INFO", "exporter"),
    ("V1016 08:41:01.134517   75769 intake.go:19] x", "DEBUG", "intake.go"), ("2025-10-14 18:45:17,550 [myid:2] - INFO  [Listener:9:SegmentPool@896] - x", "INFO", "SegmentPool"),
    ("2025-10-14 19:23:24.046 2674 WARNING nova.compute.keeper [req-45 - -] x", "WARN", "nova.compute.keeper"), ("10-13 15:31:34.013  4919  6893 I VaultUi: x", "INFO", "VaultUi"),
    ("1760417565.160 notice edge-probe - x", "INFO", "edge-probe"), ("2025-10-20 07:08:52, Info                  SRV    x", "INFO", "SRV"), ("Oct 26, 2025 7:27:37 PM a.b.C run\r\nSEVERE: x", "ERROR", "a.b.C"),
    ("25/10/28 12:01:42 WARNING LeaseWarden: x", "WARN", "LeaseWarden"), ("2025-11-01 10:33:33,246 TRACE [IPC-35] org.a.B: x", "DEBUG", "org.a.B"),
    ('{"v": 1, "ctx": {"level": "none"}, "lvl": "fine", "module": "packs/loader", "msg": "x"}', "DEBUG", "packs/loader"), ("05.11.2025 22:51:29.68 | ERROR | kette | x", "ERROR", "kette"),
    ("[WARNING] lease.table - x", "WARN", "lease.table"), ("just words", "", ""), ("", "", ""),
]


@pytest.mark.parametrize("line,level,component", LINES)
def test_levels_and_components(line, level, component):
    got = loglines.read_entry(line)
    assert (got["log_level"], got["component"]) == (level, component)


def test_unparsed_spans_and_continuations():
    text = "2025-11-01 10:33:33,246 ERROR org.a.B: boom\norg.a.XException: y\n\tat org.a.B.c(D.java:1)\nodd words here\n"
    got = loglines.read_entry(text)
    assert got["message"] == "boom" and [text[a:b] for a, b in got["unparsed"]] == ["odd words here\n"]
    assert loglines.read_entry("odd")["unparsed"] == [(0, 3)]
    many = text + "\tat x.y(Z.java:1)\n" * 3000
    assert loglines.read_entry(many)["component"] == "org.a.B"


def test_earley_keeps_the_best_of_ambiguous_parses():
    from siltstone.functions.earley import Grammar, parse

    g = Grammar({"A": "a", "AA": "aa"}, [("s", "x", 0.0), ("s", "s x", 0.0), ("x", "A", -1.0), ("x", "AA", -1.5)], "s").compiled()
    best = parse(g, "aaaa")
    assert best.score == -3.0 and [t[0] for t in best.tokens] == ["AA", "AA"]
    assert parse(g, "b") is None


def test_entries_of_both_tables(spark):
    letters = spark.createDataFrame([("d1", None, "[INFO ] a.b - x\r\n\r\n"), ("d2", "p", "x"), ("d3", None, None)], "locator string, pack string, raw_text string")
    got = {tuple(r) for r in loglines.found_entries(raw(spark, (1, "e", b"25/10/28 12:01:42 ERROR A: x\r", 1, "p", None), (2, None, b" b\n", 1, "p", None)), letters).collect()}
    assert got == {("l1", "ERROR", "A", 2), ("d1", "INFO", "a.b", 2), ("d3", "", "", 1)}
