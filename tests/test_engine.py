import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone import decode as D
from siltstone.decode.salvage import salvage
from siltstone.functions import values as V
from siltstone.operators import clustering, fused, normalise, onboarding
from siltstone.packs.spec import PackError, load_library, parse_pack
from siltstone.sources import lines, sinks

PACKS = load_library()[0]


def both(spark, column, function, texts):
    """Results of the column decoder and of the fused one."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.r.fields for r in df.select("i", column(F.col("t")).alias("r")).collect()}
    return [(got[i], (function(t) or (None,))[0]) for i, t in enumerate(texts)]


HOSTILE = ["", " ", "\n", "=", '="', 'a="b', "a=b=c", 'k="x\\"y" k=2', "ä=ö ü", "<34>", "<999>x", "<34>1 - - - - - [bad", '<34>1 t h a p m [i k="v\\"w" z="]"] b', "Oct 11 22:14:15 h su[1]: x", "Oct  1 2018 01:02:03 h a.b/c: d", "CEF:0|a|b", "CEF:0|a\\|b|c|d|e|f|g|x=1 y=two words z=\\=", "LEEF:1.0|a|b|c|d\tx=1\ty=2", "LEEF:2.0|a|b|c|d|0x09|x=1\ty=2", "LEEF:2.0|a|b|c|d|^|x=1^y", "LEEF:1", 'a,"b""c",d', '"un,terminated', 'a,"b"c,d', ",,", "x" * 5000]


@pytest.mark.parametrize("column,function", [
    (D.syslog_decoder, fused.syslog), (D.keyvalue_decoder, lambda t: fused.keyvalue(fused._pair_pattern("=", " "), t)), (lambda t: D.csv_decoder(t, ",", ["h"]), lambda t: fused.delimited(",", ["h"], t)),
    (D.cef_decoder, fused.cef), (D.leef_decoder, fused.leef),
])
def test_column_and_fused_decoders_agree(spark, column, function):
    for one, two in both(spark, column, function, HOSTILE):
        assert one == two


def test_salvage_and_generic_agree(spark):
    texts = [*HOSTILE, "to 10.0.0.1:443, [2001:db8::1] a@b.example 00:11:22:33:44:55 http://x/y?z=1 host.example:80 999.1.1.1 12:30:45", '{"a": 1.50, "b": {"c": 1}, "d": true, "e": null}', 'a=1 a=2 q="x y" ' + " ".join(f"k{i}={i}" for i in range(99))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", salvage(F.col("t")).alias("s"), D.generic_fields(F.col("t")).alias("g")).collect():
        assert [tuple(x) for x in r.s] == fused.salvage(texts[r.i])
        if not texts[r.i].startswith("{"):
            assert r.g == fused.generic(texts[r.i])
    assert len(fused.generic(texts[-1])) == 64


def test_shipped_packs_pass_their_fixtures_in_both_forms(spark):
    assert all(r["passed"] == r["fixtures"] and r["assertions_passed"] == r["assertions"] for r in onboarding.run_fixtures(PACKS))
    raw = [f["raw"] for p in PACKS for f in p.fixtures] + ["nothing known at 10.0.0.1 a=b", "<11>odd", ""]
    df = spark.createDataFrame([(i, bytearray(x.encode()), 1_700_000_000_000_000_000) for i, x in enumerate(raw)], "i int, raw binary, received_at long")
    one = {r.i: r for r in normalise.normalise(df, PACKS, 2025).drop("event").collect()}
    two = {r.i: r for r in fused.normalise(df, PACKS, 2025).collect()}
    for i in one:
        for c in ("pack_id", "disposition", "class_uid", "activity_id", "severity_id", "type_uid", "fields", "event_uid", "raw_sha256", "observables"):
            assert one[i][c] == two[i][c], (i, c)
        a, b = json.loads(one[i].event_json), json.loads(two[i].event_json)
        for e in (a, b):
            e.get("unmapped", {}).pop("reason", None)
            e.get("unmapped", {}).pop("time_source", None)
        assert a == b


def test_nothing_is_lost_and_bytes_are_kept(spark):
    rng = random.Random(3)
    raw = [None, b"", b"\xff\xfe", *[bytes(rng.randrange(256) for _ in range(rng.randrange(60))) for _ in range(50)]]
    df = spark.createDataFrame([(None if r is None else bytearray(r), i) for i, r in enumerate(raw)], "raw binary, class_uid long")
    events = fused.normalise(df, PACKS, 2025)
    assert events.count() == len(raw)
    s = normalise.stats(events).head()
    assert s.received == len(raw) == s.parsed + s.unidentified + s.extract_failed + s.normalize_failed and s.bytes_in == sum(len(r or b"") for r in raw)
    assert normalise.stats(events.limit(0)).head().coverage == 0.0


def test_bad_packs_are_refused():
    good = "identity: {id: a, vendor: v, product: p, detect: [{contains_all: [x]}]}\nextract: [{decoder: json}]\nmap: {class_uid: 1, activity_id: 1}\n"
    assert parse_pack(good).id == "a"
    for bad in (good.replace("json", "yaml"), good.replace("class_uid: 1, ", ""), good + "what: 1\n", good.replace("activity_id: 1", "activity_id: {from: a, enum: none}"), good.replace("activity_id: 1", "activity_id: 1, metadata.uid: x"), good.replace("activity_id: 1", "activity_id: 1, a: 1, a.b: 2"), good.replace("v,", "'',"), "[]"):
        with pytest.raises(PackError):
            parse_pack(bad)


@pytest.mark.parametrize("exact", [True, False])
def test_clusters(spark, exact):
    rows = [(i, f"user {i} logged in from host{i % 3}") for i in range(40)] + [(50 + i, "disk full on volume") for i in range(5)] + [(90, None), (91, "  ")]
    got = clustering.cluster(spark.createDataFrame(rows, "seq long, text string"), exact=exact).collect()
    assert [(r.cluster_id, " ".join(r.template), r.n) for r in got] == [("C0001", "user <*> logged in from <*>", 40), ("C0002", "disk full on volume", 5)]
    assert got[0].specificity == 4 / 6 and len(got[0].samples) == 30
    apart = spark.createDataFrame([(i, f"w{i} x{i}" + " y" * (i % 2)) for i in range(9)], "seq long, text string")
    capped = clustering.cluster(apart, cap=3, exact=exact).collect()
    assert sum(r.n for r in capped) == 9 and [(r.n, r.template) for r in capped if r.cluster_id == "overflow"] == [(6, None)] and len(capped) == 4
    assert clustering.cluster(apart.limit(0), cap=3, exact=exact).count() == 0
    many = spark.createDataFrame([(i, f"w{i} x{i}") for i in range(1100)], "seq long, text string")
    got = clustering.cluster(many, exact=exact).collect()
    assert len(got) == 1100 and all(r.template and r.samples and r.n == 1 for r in got)


def test_templates_against_a_plain_version():
    """The first of the most similar templates, at least two of two literals kept."""
    import random

    def plain(lines):
        found = []
        for tokens in lines:
            best, top = None, 0.4
            for c in found:
                same = sum(a in ("<*>", b) for a, b in zip(c, tokens)) / len(tokens)
                kept = sum(a == b for a, b in zip(c, tokens))
                if same >= 0.4 and not (sum(a != "<*>" for a in c) >= 2 and kept < 2) and (best is None or same > top):
                    best, top = c, same
            if best is None:
                found.append(list(tokens))
            else:
                best[:] = [a if a == b else "<*>" for a, b in zip(best, tokens)]
        return found

    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 7)
        lines = [[rng.choice("abcdef") for _ in range(n)] for _ in range(40)]
        t = clustering.Templates()
        for i, tokens in enumerate(lines):
            t.add(tokens, i, 1, [])
        assert [c["template"] for c in t.clusters] == plain(lines) and sum(c["n"] for c in t.clusters) == 40


def test_shared_by_all(spark):
    df = spark.createDataFrame([("fw acme deny a acme",), ("acme fw deny b",), (None,)], "text string")
    assert [tuple(r) for r in clustering.shared_by_all(df, most=2).collect()] == [("acme", 2), ("deny", 2)]


SAMPLES = [f"<34>Oct 11 22:14:0{i} box acmefw[1]: action=deny src=10.0.0.{i} dst=10.1.1.1 proto=tcp" for i in range(5)]


def test_profiles_and_sampling():
    got = onboarding.profile(SAMPLES)
    assert got["wire_format"] == "syslog-keyvalue" and onboarding.diverse_indices(["aa b", "a", "c d e"], 2) == [1, 0]
    scores = dict((n, s) for s, n in onboarding.family_scores(["squid proxy http GET"]))
    assert scores["web-or-proxy"] == 10.3 and len(scores) == 9 and onboarding.family(["squid proxy http GET"]) == ("web-or-proxy", 4002, 0.95)
    assert onboarding.family(["nothing of note"])[0] == "unknown" and onboarding.family(["postgres query"])[:2] == ("database", None)
    assert onboarding.family(["message-id=<1> smtp"])[0] == "email"
    cef = onboarding.hypotheses(["CEF:0|Ac\\|me|Box|1|1|n|5|a=b"], "cef")
    assert [(h["vendor"], h["product"], h["confidence"]) for h in cef] == [("Ac|me", "Box", 0.99)]
    assert [(h["product"], h["confidence"]) for h in onboarding.hypotheses(["CEF:0"], "cef")] == [("CEF", 0.65)]
    assert [h["product"] for h in onboarding.hypotheses(["sshd[1]: x %ASA-6-1"], "unstructured")] == ["ASA", "OpenSSH"]
    assert onboarding.field_names(['{"a": 1, "b": {}}', "x=1 y.z=2 a=3 é=4"]) == ["a", "b", "x", "y.z"] and onboarding.field_names(["1,2,3"]) == ["col.0", "col.1", "col.2"] and onboarding.field_names(["a b"]) == []


def test_detectors_fall_back_in_order():
    assert onboarding.detector(SAMPLES) == (["acmefw[1]:", "<34>Oct", "action="], SAMPLES)
    logins = ["Jun 15 combo -- ROOT LOGIN ON tty1", "Jun 16 combo -- ROOT LOGIN ON tty2"]
    assert onboarding.detector(logins)[0] == ["combo -- ROOT LOGIN ON"]
    mixed = [*logins, "GET / x"]
    literals, claimed = onboarding.detector(mixed)
    assert literals == ["combo -- ROOT LOGIN ON"] and claimed == logins
    assert onboarding.detector(["a b", "c d"]) == ([onboarding.PLACEHOLDER], [])
    assert onboarding.is_volatile("a123") and onboarding.is_volatile("1:2") and not onboarding.is_volatile("a12") and not onboarding.is_field_key("1.2") and onboarding.is_field_key("src-ip")
    assert onboarding.slug("[Acme FW]: 9") == "acme-fw-9" and onboarding.suggested_id(SAMPLES, "syslog-keyvalue", "k") == "34-oct-syslog-keyvalue" and onboarding.suggested_id(["a b"], "xml", "k 1") == "unknown-xml-k-1"


def test_drafts_checks_and_approval(tmp_path):
    draft = onboarding.draft(SAMPLES, "k")
    assert draft["identity"]["priority"] == 1000 and draft["map"]["src_endpoint.ip"]["from"] == "src" and onboarding.draft(["a", "b"], "k") is None
    ssh = [f"Oct 11 22:14:0{i} box sshd[7]: user=ann{i} login password" for i in range(5)]
    made = onboarding.draft_from_evidence(ssh, "k")
    assert (made["identity"]["product"], made["map"]["class_uid"], made["map"]["activity_id"]) == ("OpenSSH", 3002, 0) and made["provenance"]["fixtures_passed"] == 3
    firewall = onboarding.draft_from_evidence([s + " snort classification alert" for s in SAMPLES], "k")
    assert firewall["map"]["class_uid"] == 4001 and "src_endpoint.ip" in firewall["map"]  # the class of its family has no endpoints
    assert onboarding.draft_from_evidence(["a b", "c d"], "k")["identity"]["detect"][0]["contains_all"] == [onboarding.PLACEHOLDER]
    assert onboarding.unknown_paths({"url": 1, "message": 1}) == ["url"] and not onboarding.class_accepts(2004, "src_endpoint.ip") and onboarding.class_accepts(9, "class_uid")
    folder = tmp_path / "candidates"
    manifest = json.loads(open(onboarding.write_drafts([draft | {"records": 5}], str(folder), "in.log", 9)).read())
    assert manifest["approval_required"] and manifest["records_read"] == 9 and manifest["clusters"][0]["records"] == 5
    text = open(manifest["clusters"][0]["candidate"]).read()
    live = tmp_path / "live"
    live.mkdir()
    assert onboarding.approve_pack(text, str(live)).endswith(".yaml") and len(list(live.iterdir())) == 1
    bad = text.replace("class_uid: 4001", "class_uid: 4002", 1)
    assert not onboarding.check_pack(bad)["ok"] and not onboarding.check_pack("[")["ok"] and not onboarding.check_pack("a: 1")["ok"]
    with pytest.raises(ValueError):
        onboarding.approve_pack(bad, str(live))
    assert len(list(live.iterdir())) == 1 and onboarding.safe_stem("../a b") == "_a_b"
    with pytest.raises(ValueError):
        onboarding.safe_stem("..")
    program = ["python", "-c", f"import sys, json; json.load(sys.stdin); print(open({manifest['clusters'][0]['candidate']!r}).read())"]
    assert onboarding.sidecar(program)(SAMPLES, "k")["identity"] == draft["identity"] and onboarding.sidecar(["echo", "a: 1"])(SAMPLES, "k") is None


def test_unknown_lines_to_profiles_and_candidates(spark, tmp_path):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)] + [(9, "a b"), (10, None)], "seq long, text string")
    assert [(r.n, json.loads(r.profile)["wire_format"]) for r in onboarding.profile_lines(df).collect()] == [(5, "syslog-keyvalue"), (1, "unstructured")]
    manifest = json.loads(open(onboarding.draft_lines(df, str(tmp_path / "out"), "dead letters")).read())
    assert manifest["records_read"] == 7 and [c["records"] for c in manifest["clusters"]] == [5]


def test_coverage_regression_and_values(spark):
    schema = "corpus string, parsed_share double"
    got = onboarding.coverage_regression(spark.createDataFrame([("a", 0.99), ("b", 0.5), ("n", 1.0)], schema), spark.createDataFrame([("a", 0.9901), ("b", 0.6), ("c", 1.0)], schema))
    assert {r.corpus: r.verdict for r in got.collect()} == {"a": "kept", "b": "lost", "c": "missing", "n": "new"}
    match = onboarding.values_match
    assert match(1, 1.0) and match(1, "1") and match("x", "x") and not match(True, 1) and not match(True, "True") and not match("1", "01") and match(None, None)
    assert onboarding.shadowed(PACKS) == []


def test_vault_round_trip(spark, tmp_path):
    key = b"0123456789abcdef"
    raw = spark.createDataFrame([(bytearray(f"record {i}\n".encode() * (i % 5)), i) for i in range(50)], "raw binary, seq long")
    for k in (None, key):
        path = str(tmp_path / f"vault{k is None}")
        sinks.to_vault(raw, 7, k).write.parquet(path)
        vault = lines.read_vault(spark, path, k)
        rows = vault.orderBy("offset", "seq").collect()
        assert all(r.intact for r in rows) and [r.seq for r in rows] == list(range(50))
        assert lines.lookup(vault, rows[9].locator) == b"record 9\n" * 4
        with pytest.raises(LookupError):
            lines.lookup(vault, rows[9].locator[:-1] + "f")
    assert not lines.read_vault(spark, str(tmp_path / "vaultFalse"), b"f" * 16).where("intact").count()


def test_features_archive_and_letters(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"Mar  3 04:05:06 gate kernel: INBOUND TCP: IN=br0 SRC=10.0.0.1 DST=8.8.8.8 PROTO=TCP SPT=1 DPT=2"), 1760000000 * 10**9), (bytearray(b"junk"), None)], "raw binary, received_at long")
    events = fused.normalise(df, PACKS, 2025)
    rows = sinks.feature_table(events).collect()
    assert len(rows[0]) == 24 and all(v is not None for r in rows for v in r)
    flow = next(r for r in rows if r.src_ip)
    assert (flow.src_is_private, flow.dst_is_private, flow.src_port, flow.hour_of_day, flow.day_of_week) == (1, 0, 1, 8, 3)
    sinks.write_archive(events.where("time is not null"), str(tmp_path / "a"))
    assert [r.dt.isoformat() for r in spark.read.parquet(str(tmp_path / "a")).select("dt").distinct().collect()] == ["2025-10-09"]
    sinks.write_dead_letters(normalise.dead_letters(events), str(tmp_path / "d"))
    assert lines.read_dead_letters(spark, str(tmp_path / "d")).head().raw_text == "junk"
    with pytest.raises(ValueError):
        sinks.check_paths(["x"], ["y", "./x"])


def test_private_addresses(spark):
    cases = {"10.1.2.3": 1, "172.31.0.1": 1, "172.32.0.1": 0, "192.168.1.1": 1, "127.0.0.1": 1, "169.254.1.1": 1, "0.0.0.0": 1, "8.8.8.8": 0, "fe80::1": 1, "fd00::1": 1, "::1": 1, "2001:db8::1": 0, "x": 0, "": -1, None: -1}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "ip string, want int")
    assert df.where(V.is_private(F.col("ip")) != F.col("want")).count() == 0


def test_stream_of_files(spark, tmp_path):
    from siltstone.streaming import pipeline

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b"Mar  3 04:05:06 gate kernel: X: IN=br0 SRC=10.0.0.1 DST=8.8.8.8 PROTO=TCP\r\n\nother\n")
    query = pipeline.start(pipeline.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), 2025)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.disposition for r in got.collect()} == {"parsed", "unidentified"} and got.count() == 3
