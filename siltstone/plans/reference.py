"""Queries for the engine's own operators.

Lines are rendered from the columns of the test tables and decoded again; the SQL computes the
same answer from the columns, so that it shares nothing with the decoders.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import decode as D
from ..decode.salvage import salvage
from ..functions import values as V
from ..functions.times import parse_time
from ..operators import clustering, fused, integrity, normalise, onboarding
from ..packs import compile as C
from ..packs.spec import load_library, parse_pack
from ..session import cut, scratch, table
from ..sources import lines, sinks

YEAR = 2025
_PACKS: list = []


def packs() -> list:
    if not _PACKS:
        _PACKS.extend(load_library()[0])
    return _PACKS


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _get(name: str, key: str) -> Column:
    return F.try_element_at(F.col(name), F.lit(key))


def _decoded(df: DataFrame, line: Column, decoder, keep: list[str]) -> DataFrame:
    return df.select(*keep, line.alias("line")).select(*keep, decoder(F.col("line")).alias("r")).select(*keep, F.col("r.fields").alias("f"), F.col("r.body").alias("body"))


# --- decoders ---------------------------------------------------------------------------------------


def kv_decode(spark, d):
    e = table(spark, d, "events")
    line = F.concat_ws(" ", F.concat(F.lit("user="), _s("user_id")), F.concat(F.lit("type="), "event_type"), F.lit("noise"), F.concat(F.lit("user="), _s("event_id")))
    return _decoded(e, line, D.keyvalue_decoder, ["event_id"]).select("event_id", _get("f", "user").alias("user"), _get("f", "type").alias("type"))


def kv_quoted(spark, d):
    p = table(spark, d, "part")
    line = F.concat(F.lit('name="'), F.col("p_name"), F.lit(' \\"q\\"" brand="'), F.col("p_brand"), F.lit('" size='), _s("p_size"))
    return _decoded(p, line, D.keyvalue_decoder, ["p_partkey"]).select("p_partkey", _get("f", "name").alias("name"), _get("f", "brand").alias("brand"), _get("f", "size").alias("size"))


def csv_positional(spark, d):
    c = table(spark, d, "customer")
    line = F.concat_ws(",", _s("c_custkey"), "c_name", _s("c_nationkey"), F.lit(""), "c_mktsegment")
    out = _decoded(c, line, lambda t: D.csv_decoder(t, ",", ["key", "name"]), ["c_custkey"])
    return out.select("c_custkey", _get("f", "name").alias("name"), _get("f", "col.2").alias("nation"), _get("f", "col.3").alias("empty"), _get("f", "col.4").alias("segment"), _get("f", "col.count").alias("n"))


def csv_quoted(spark, d):
    t = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    line = F.concat(_s("doc_id"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('",end'))
    return _decoded(t, line, D.csv_decoder, ["doc_id"]).select("doc_id", _get("f", "col.1").alias("text"), _get("f", "col.2").alias("tail"))


def syslog_bsd(spark, d):
    o = table(spark, d, "orders")
    pri = F.col("o_orderkey") % 192
    line = F.concat(F.lit("<"), pri.cast("string"), F.lit(">"), F.date_format("o_orderdate", "MMM "), F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, " "), F.lit(" 01:02:03 host-"), _s("o_custkey"), F.lit(" app["), _s("o_orderkey"), F.lit("]: "), "o_orderpriority")
    out = _decoded(o, line, D.syslog_decoder, ["o_orderkey"])
    return out.select("o_orderkey", *[_get("f", f"syslog.{k}").alias(k) for k in ("facility", "severity", "hostname", "appname", "procid")], "body")


def syslog_ietf(spark, d):
    o = table(spark, d, "orders")
    line = F.concat(F.lit("<"), (F.col("o_orderkey") % 192).cast("string"), F.lit(">1 2025-01-02T03:04:05Z h - "), _s("o_custkey"), F.lit(' - [ex@1 st="'), "o_orderstatus", F.lit('" pr="x y"] '), "o_orderpriority")
    out = _decoded(o, line, D.syslog_decoder, ["o_orderkey"])
    return out.select("o_orderkey", _get("f", "syslog.severity").alias("severity"), _get("f", "syslog.appname").alias("appname"), _get("f", "syslog.procid").alias("procid"), _get("f", "syslog.sd.ex@1.st").alias("st"), _get("f", "syslog.sd.ex@1.pr").alias("pr"), "body")


def cef_decode(spark, d):
    s = table(spark, d, "supplier")
    line = F.concat(F.lit("<9>CEF:0|A\\|B|"), "s_name", F.lit("|1|"), _s("s_suppkey"), F.lit("|two words|5|src=10.0.0.1 msg=eq\\=ual and more nation="), _s("s_nationkey"))
    out = _decoded(s, line, D.cef_decoder, ["s_suppkey"])
    return out.select("s_suppkey", _get("f", "cef.device_vendor").alias("vendor"), _get("f", "cef.device_product").alias("product"), _get("f", "msg").alias("msg"), _get("f", "nation").alias("nation"))


def leef_decode(spark, d):
    p = table(spark, d, "part")
    line = F.concat(F.lit("LEEF:2.0|V|P|1|"), _s("p_partkey"), F.lit("|^|name="), "p_name", F.lit("^size="), _s("p_size"), F.lit("^eq=a\\=b"))
    out = _decoded(p, line, D.leef_decoder, ["p_partkey"])
    return out.select("p_partkey", _get("f", "leef.event_id").alias("event_id"), _get("f", "name").alias("name"), _get("f", "size").alias("size"), _get("f", "eq").alias("eq"))


def json_flatten(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit('{"id": '), _s("event_id"), F.lit(', "a": {"b": [1, {"c": "'), "event_type", F.lit('"}]}, "n": null, "props": '), "props", F.lit("}"))
    out = _decoded(e, line, D.json_decoder, ["event_id"])
    return out.select("event_id", _get("f", "a.b.1.c").alias("c"), _get("f", "a.b.len").alias("n"), _get("f", "props.k").alias("k"))


def xml_flatten(spark, d):
    p = table(spark, d, "part")
    line = F.concat(F.lit('<p key="'), _s("p_partkey"), F.lit('"><n>a &amp; b</n><n>'), _s("p_size"), F.lit("</n><!-- x --></p>"))
    out = _decoded(p, line, D.xml_decoder, ["p_partkey"])
    return out.select("p_partkey", _get("f", "p.@key").alias("key"), _get("f", "p.n").alias("first"), _get("f", "p.n.1").alias("second"))


def regex_alternatives(spark, d):
    li = table(spark, d, "lineitem")
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("returned "), _s("l_orderkey"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("accepted order "), _s("l_orderkey"))).otherwise(F.concat(F.lit("none/"), _s("l_orderkey")))
    patterns = [r"^returned (?P<key>\d+)$", r"accepted (?P<what>\w+) (?P<key>\d+)", r"(?P<key>\d+)"]
    out = _decoded(li, line, lambda t: D.regex_decoder(t, patterns), ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", _get("f", "regex.matched").alias("matched"), _get("f", "key").alias("key"), _get("f", "what").alias("what"))


def generic_pairs(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("<14>odd line a.b="), _s("user_id"), F.lit(' q="x y" a.b=2 t='), "event_type")
    out = e.select("event_id", D.generic_fields(line).alias("f"), D.generic_severity(line).alias("severity"))
    return out.select("event_id", _get("f", "a.b").alias("ab"), _get("f", "q").alias("q"), _get("f", "t").alias("t"), F.col("severity").cast("int").alias("severity"))


def salvage_found(spark, d):
    f = table(spark, d, "features")
    line = F.concat(F.lit("from "), "src_ip", F.lit(" to ["), "dst_ip", F.lit("]:"), _s("dst_port"), F.lit(" mail a.b@ex.org, see https://ex.org/x?y=1 end"))
    return f.select(F.inline(salvage(line))).groupBy("type_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


# --- identification and mapping -----------------------------------------------------------------------

_DEMO = """
identity: {id: demo-pairs, vendor: V, product: P, log_format: kv, priority: 10, detect: [{contains_all: ["type=", "user="], contains_none: ["secret"]}]}
extract: [{decoder: keyvalue}]
map:
  class_uid: 4001
  activity_id: {from: type, enum: types, default: 99}
  severity_id: 1
  time: {from: at, format: epoch_s}
  actor.user.name: {from: [nick, user], observable: user}
  count: {from: n, as: int, default: -1}
enums: {types: {click: 1, view: 2, "7": 7}}
"""


def _demo(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    line = F.concat(F.lit("type="), "event_type", F.lit(" user="), _s("user_id"), F.lit(" nick=- at="), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit(" n="), F.when(F.col("event_id") % 3 == 0, "x").otherwise(_s("event_id")), F.lit(" left=over"))
    return e.select("event_id", line.cast("binary").alias("raw"))


def mapping(spark, d):
    ev = fused.normalise(_demo(spark, d), [parse_pack(_DEMO)], YEAR)
    return ev.select("event_id", "activity_id", "time", F.get_json_object("event_json", "$.actor.user.name").alias("user"), F.get_json_object("event_json", "$.count").cast("bigint").alias("n"), _get("unmapped", "left").alias("left"), F.size("observables").cast("int").alias("n_observables"))


def mapping_columns(spark, d):
    """The same by column expressions alone."""
    ev = normalise.normalise(_demo(spark, d), [parse_pack(_DEMO)], YEAR)
    return ev.select("event_id", "activity_id", "time", F.get_json_object("event_json", "$.actor.user.name").alias("user"), F.get_json_object("event_json", "$.count").cast("bigint").alias("n"), _get("unmapped", "left").alias("left"), F.size("observables").cast("int").alias("n_observables"))


def identify_priority(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 5
    line = (
        F.when(k == 0, "x CEF:0|Check Point|VPN-1|1|1|n|5|src=1.2.3.4").when(k == 1, "CEF:0|Acme|Box|1|1|n|5|a=b").when(k == 2, "devname=a type=traffic srcip=1.2.3.4 dstip=1.2.3.5 SRC= DST= PROTO=")
        .when(k == 3, "<30>Jun 14 15:16:01 combo cron[19939]: job done").otherwise(F.concat(F.lit("nothing "), _s("event_id")))
    )
    return e.select("event_id", C.identify(line, packs()).alias("pack_id"))


#: How the connections of the feature table are written as lines: pack, whether it tells the source address, and the line,
#: with ``{src}`` and so on for the columns (an absent address is ``-``). Connections are spread over them by source port.
LINES = [
    ("linux-iptables-firewall", True, "Mar  3 04:05:06 gate kernel: INBOUND TCP: IN=br0 PHYSIN=eth0 OUT=br0 SRC={src} DST={dst} PROTO={proto} SPT={sport} DPT={dport}"),
    ("linux-iptables-firewall", True, "Mar  3 04:05:06 gate kernel: Drop TCP after 13 attempts IN=br0 OUT=br0 SRC={src} DST={dst} PROTO={proto} SPT={sport} DPT={dport}"),
    ("fortinet-fortigate-traffic", True, "devname=fw type=traffic srcip={src} dstip={dst} srcport={sport} dstport={dport} proto=6 action=accept"),
    ("generic-cef-network", True, "CEF:0|Acme|Box|1|1|n|5|src={src} dst={dst} spt={sport} dpt={dport}"),
    ("squid-proxy-access", True, "1700000000.123     45 {src} TCP_MISS/200 512 GET http://host.example/{sport} - DIRECT/{dst} text/html"),
    ("apache-access-http", True, '{src} - ann [10/Oct/2025:13:55:36 +0000] "GET /{sport} HTTP/1.1" 200 23'),
    ("zeek-conn", True, "1700000000.5\tC1\t{src}\t{sport}\t{dst}\t{dport}\ttcp\t-\t1.5\t10\t20\tSF\t-\t0\tShADadFf\t5\t300\t4\t200\t-"),
    ("pfsense-filterlog", True, "<134>Mar  3 04:05:06 gate filterlog[1]: 5,,,100,em0,match,pass,in,4,0x0,,64,1,0,none,6,tcp,60,{src},{dst},{sport},{dport}"),
    ("suricata-eve-alert", True, '{"timestamp":"2025-10-11T01:02:03.5+0000","event_type":"alert","src_ip":"{src}","src_port":{sport},"dest_ip":"{dst}","dest_port":{dport},"proto":"{proto}","alert":{"signature":"s","severity":2}}'),
    ("sendmail-mta", False, "Mar  3 04:05:06 post sendmail[2606]: j2D9FD3X026: from=ann, size={sport}, class=0, relay={dst}"),
    ("openssh-auth", False, "Mar  3 04:05:06 gate sshd[7]: Failed password for ann from 192.0.2.7 port {sport} ssh2"),
    ("cisco-asa-network", False, "<166>Oct 10 2018 12:34:56 fw1 : %ASA-6-302013: Built outbound TCP connection 11 for outside:192.0.2.7/53500 to inside:198.51.100.9/{dport}"),
    ("linux-syslog-host", False, "<30>Jun 14 15:16:01 combo cron[19939]: job {sport} done"),
    (None, False, "unclaimed {src}"),
]
_COLUMNS = {"src": "coalesce(nullif(src_ip, ''), '-')", "dst": "coalesce(nullif(dst_ip, ''), '-')", "proto": "protocol", "sport": "CAST(abs(src_port) AS STRING)", "dport": "CAST(abs(dst_port) AS STRING)"}


def _line(template: str) -> str:
    """SQL, of either engine, for a line."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(_COLUMNS[x] if i % 2 else "'" + x + "'" for i, x in enumerate(parts))


_K = f"((src_port % {len(LINES)}) + {len(LINES)}) % {len(LINES)}"
_LINE = f"CASE {_K} " + " ".join(f"WHEN {k} THEN {_line(line)}" for k, (_, _, line) in enumerate(LINES)) + " END"


def _connections(spark, d) -> DataFrame:
    f = table(spark, d, "features").select("event_uid", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "time_ns", "pack_id").distinct()
    return f.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes but much work per row: not to be coalesced


def _events(spark, d, *wanted: str) -> DataFrame:
    raw = _connections(spark, d).select(F.expr(_LINE).cast("binary").alias("raw"), F.col("time_ns").alias("received_at"), F.col("event_uid").alias("locator"))
    return fused.normalise(raw, packs(), YEAR, columns=wanted or None)


def flows(spark, d):
    """Flagship: lines of thirteen layouts to events, counted by pack and activity."""
    ev = _events(spark, d, "disposition", "pack_id", "activity_id", "event_json")
    return ev.where("disposition = 'parsed'").groupBy("pack_id", "activity_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.get_json_object("event_json", "$.src_endpoint.ip")).alias("n_src"))


def stats(spark, d):
    return normalise.stats(_events(spark, d, "disposition", "observables", "unmapped", "raw_size")).withColumn("coverage", F.round("coverage", 6))


def by_pack(spark, d):
    return normalise.by_pack(_events(spark, d, "disposition", "pack_id"))


def dead_letters(spark, d):
    return normalise.dead_letters(_events(spark, d, "text", "disposition", "reason", "pack_id")).groupBy("disposition", "raw_encoding").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw_text")).alias("chars"))


def feature_rows(spark, d):
    line = F.concat(F.lit("Mar  3 04:05:06 gate kernel: INBOUND TCP: IN=br0 PHYSIN=eth0 OUT=br0 SRC="), "src_ip", F.lit(" DST="), "dst_ip", F.lit(" PROTO="), "protocol", F.lit(" SPT="), _s("src_port"), F.lit(" DPT="), _s("dst_port"))
    raw = _connections(spark, d).select(line.cast("binary").alias("raw"), F.col("time_ns").alias("received_at"), F.col("event_uid").alias("locator"))
    f = sinks.feature_table(fused.normalise(raw, packs(), YEAR))
    return f.groupBy("src_is_private", "dst_is_private", "hour_of_day", "day_of_week").agg(F.count(F.lit(1)).alias("n"), F.sum("src_port").alias("ports"), F.sum("is_alert").alias("alerts"))


def evidence_run(spark, d):
    """The whole way of every line: into a vault, out of it again, to an event, into a chain, verified, and into a Merkle log."""
    raw = cut(_connections(spark, d).select(F.expr(_LINE).cast("binary").alias("raw"), F.col("time_ns").alias("received_at"), F.monotonically_increasing_id().alias("seq")))
    path = f"{scratch(spark, 'vault')}/records"
    sinks.seal_vault(sinks.append_vault(raw.select("raw", "seq"), path, 0), path)
    kept = lines.read_vault(spark, path).where("intact").select("raw", "locator", F.col("offset").alias("seq"))
    events = fused.normalise(kept, packs(), YEAR, columns=("event_uid", "event_json"))
    chained = events.select(F.concat(F.lit("chain-"), F.pmod(F.xxhash64("locator"), F.lit(64)).cast("string")).alias("chain_uid"), "seq", "event_uid", "event_json")
    attested = cut(integrity.attest(chained))
    log = integrity.leaves(integrity.numbered(attested.select("seq", "fingerprint"), "seq"), "idx", "fingerprint")
    n_leaves, root = log.count(), integrity.merkle_root(log)
    return integrity.verify_chains(attested).agg(F.sum("n_events").alias("n_events"), F.sum("n_bad").alias("n_bad")).select("*", F.lit(n_leaves).cast("bigint").alias("n_leaves"), F.lit(len(root)).cast("int").alias("root_digits"))


# --- scalars ------------------------------------------------------------------------------------------------


def coercions(spark, d):
    e = table(spark, d, "events")
    v = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), _s("user_id"), F.lit(" "))).when(F.col("event_id") % 4 == 1, "7.5").when(F.col("event_id") % 4 == 2, "N/A").otherwise("Yes")
    return e.select("event_id", V.present(v).alias("present"), V.as_int(v).alias("as_int"), V.as_bool(v).alias("as_bool"))


def times(spark, d):
    o = table(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        "o_orderkey",
        parse_time(F.unix_seconds(at).cast("string"), "epoch_s", YEAR).alias("epoch_s"), parse_time((F.unix_seconds(at) * 1000).cast("string"), "epoch_ms", YEAR).alias("epoch_ms"),
        parse_time(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456789+02:00")), "rfc3339", YEAR).alias("rfc3339"),
        parse_time(F.date_format(at, "yyyy-MM-dd HH:mm"), "date_time", YEAR).alias("date_time"), parse_time(F.date_format(at, "yyyy/MM/dd HH:mm:ss"), "slash_date_time", YEAR).alias("slash_date_time"),
        parse_time(F.date_format(at, "dd/MMM/yyyy:HH:mm:ss -0130"), "clf", YEAR).alias("clf"), parse_time(F.concat(F.date_format(at, "MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.lit(" 00:00:01")), "rfc3164", 2024).alias("rfc3164"),
        parse_time(F.lit("2025-13-01 00:00:00"), "date_time", YEAR).alias("bad"),
    )


def locators(spark, d):
    li = table(spark, d, "lineitem")
    loc = V.locator(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("bigint"))
    return li.select("l_orderkey", "l_linenumber", loc.alias("locator"), V.parse_locator(loc)["offset"].alias("back"))


def raw_hash(spark, d):
    """Size and digest of every record, a null one as empty."""
    raw = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return fused.normalise(raw, [], YEAR, columns=("raw_sha256", "raw_size")).select("doc_id", F.col("raw_sha256").alias("sha256"), F.col("raw_size").alias("n_bytes"))


def private_flags(spark, d):
    f = table(spark, d, "features")
    return f.groupBy(V.is_private(F.col("src_ip")).alias("computed"), "src_is_private").agg(F.count(F.lit(1)).alias("n"))


def templates(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", V.template(F.concat(F.lit("User "), "event_type", F.lit(" id="), _s("event_id"), F.lit(" at 10.0.0.1 n "), _s("user_id"))).alias("template"))


def vault_offsets(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(F.col("o_orderpriority").cast("binary").alias("raw"), F.col("o_orderkey").alias("seq"))
    return sinks.to_vault(raw, 3).select("seq", "offset", "len", "crc32", "locator")


# --- integrity, onboarding ------------------------------------------------------------------------------------


def _chained(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("chain-"), (F.col("user_id") % 20).cast("string")).alias("chain_uid"), F.col("event_id").alias("seq"), _s("event_id").alias("event_uid"), F.to_json(F.struct(F.lit(400106).alias("type_uid"), F.col("event_type").alias("message"), F.struct(_s("event_id").alias("uid")).alias("metadata"))).alias("event_json"))


def chain_verify(spark, d):
    return integrity.verify_chains(integrity.attest(_chained(spark, d))).select("chain_uid", "n_events", "n_bad", "ok")


def chain_tampered(spark, d):
    """Chains of which every event with a number divisible by 50 was altered after the fact, and every one divisible by 70 taken out."""
    attested = integrity.attest(_chained(spark, d)).where("seq % 70 <> 0")
    altered = attested.withColumn("event_json", F.when(F.col("seq") % 50 == 0, F.replace("event_json", F.lit('"message":"'), F.lit('"message":"x'))).otherwise(F.col("event_json")))
    return integrity.verify_events(altered).groupBy("own_ok", "link_ok").agg(F.count(F.lit(1)).alias("n"))


def merkle(spark, d):
    o = table(spark, d, "raw_events").select("raw_id", F.coalesce("raw", F.lit(b"")).alias("raw"))
    level = integrity.leaves(integrity.numbered(o, "raw_id"), "idx", "raw")
    root = integrity.merkle_root(level)
    return spark.createDataFrame([(root, level.count())], "root string, n bigint")


def merkle_level(spark, d):
    o = table(spark, d, "customer").withColumn("idx", F.col("c_custkey") - 1)
    return integrity.next_level(integrity.leaves(o, "idx", "c_name"))


def clusters(spark, d):
    """Lines of three lengths, of which each is one shape."""
    text = F.concat("event_type", F.lit(" by user "), _s("user_id"), F.lit(" no "), _s("event_id"), F.repeat(F.lit(" pad"), (F.col("event_id") % 3).cast("int")))
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), text.alias("text"))
    return clustering.cluster(e).select("cluster_id", "n_tokens", "first_seq", F.array_join("template", " ").alias("template"), "n", F.round("specificity", 6).alias("specificity"))


def cluster_profiles(spark, d):
    e = table(spark, d, "dead_letters").where("pack is null").withColumn("seq", F.xxhash64("locator"))
    return onboarding.profiles(clustering.cluster(e, "raw_text"))


def fixture_report(spark, d):
    return spark.createDataFrame(onboarding.run_fixtures(packs()), "pack string, fixtures int, passed int, assertions int, assertions_passed int")


def recent(spark, d):
    """The last 500 by order of arrival: a top-k report."""
    return lines.recent(table(spark, d, "raw_events"), "raw_id", 500).select("raw_id", "locator", "transport")


def event_rows(spark, d):
    """What a console lists of every recent event."""
    stored = table(spark, d, "recent_events").select("locator", "disposition", F.col("pack").alias("pack_id"), "event_json").distinct()
    return sinks.summary(stored).select("locator", "pack", "disposition", "uid", "class_uid", "type_uid", "severity_id", "src_ip", "dst_port")


def vault_index(spark, d):
    """Records stored in two segments, one sealed: what recovery finds."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").cast("binary").alias("raw"), F.col("o_orderkey").alias("seq"))
    path = f"{scratch(spark, 'vault')}/records"
    sinks.seal_vault(sinks.append_vault(o.where("seq % 2 = 0"), path, 0), path)
    sinks.append_vault(o.where("seq % 2 = 1"), path, 1)
    return lines.unseal(spark, path).groupBy("segment", "sealed").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("offset") + F.col("len")).alias("bytes"))


QUERIES = {
    f.__name__: f for f in (
        kv_decode, kv_quoted, csv_positional, csv_quoted, syslog_bsd, syslog_ietf, cef_decode, leef_decode, json_flatten, xml_flatten, regex_alternatives, generic_pairs, salvage_found,
        mapping, mapping_columns, identify_priority, flows, stats, by_pack, dead_letters, feature_rows, coercions, times, locators, raw_hash, private_flags, templates, vault_offsets,
        chain_verify, chain_tampered, merkle, merkle_level, clusters, cluster_profiles, fixture_report, recent, event_rows, vault_index, evidence_run,
    )
}


def queries():
    return dict(QUERIES)


_MAPPED = """SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 99 END AS BIGINT) AS activity_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS time, CAST(user_id AS VARCHAR) AS "user",
 CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS n, 'over' AS "left", CAST(1 AS INT) AS n_observables FROM events"""
_FLOW = "(SELECT DISTINCT event_uid, src_ip, dst_ip, src_port, dst_port, protocol, time_ns, pack_id FROM features)"


def _crc(*texts: str) -> str:
    return " ".join(f"WHEN '{t}' THEN {zlib.crc32(t.encode())}" for t in texts)


_SALVAGED = """SELECT CAST(2 AS INT) AS type_id, CAST(sum(len(list_distinct(list_filter([src_ip, dst_ip], lambda x: x <> '')))) AS BIGINT) AS n, (SELECT count(DISTINCT x) FROM (SELECT src_ip AS x FROM features UNION SELECT dst_ip FROM features) WHERE x <> '') AS n_values FROM features
 UNION ALL SELECT unnest([5, 6]), count(*), 1 FROM features"""
_ACTIVITY = {"linux-iptables-firewall": 6, "fortinet-fortigate-traffic": 6, "generic-cef-network": 6, "squid-proxy-access": 3, "apache-access-http": 3, "zeek-conn": 6, "pfsense-filterlog": 6, "suricata-eve-alert": 1, "sendmail-mta": 1, "openssh-auth": 1, "cisco-asa-network": 1, "linux-syslog-host": 99}
_WRITTEN = f"""(SELECT f.*, {_LINE.replace("AS STRING", "AS VARCHAR")} AS line, t.pack_id, t.told, t.activity_id FROM (SELECT DISTINCT event_uid, src_ip, dst_ip, src_port, dst_port, protocol, time_ns, pack_id AS stored_pack FROM features) f
 JOIN (VALUES {", ".join(f"({k}, {repr(p) if p else 'CAST(NULL AS VARCHAR)'}, {str(told).lower()}, CAST({3 if k == 1 else _ACTIVITY.get(p, 0)} AS BIGINT))" for k, (p, told, _) in enumerate(LINES))}) t(k, pack_id, told, activity_id) ON t.k = {_K})"""


def oracle_sql():
    return {
        "kv_decode": "SELECT event_id, CAST(event_id AS VARCHAR) AS \"user\", event_type AS type FROM events",
        "kv_quoted": "SELECT p_partkey, p_name || ' \"q\"' AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part",
        "csv_positional": "SELECT c_custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, '' AS empty, c_mktsegment AS segment, '5' AS n FROM customer",
        "csv_quoted": "SELECT doc_id, coalesce(text, '') AS text, 'end' AS tail FROM documents",
        "syslog_bsd": "SELECT o_orderkey, CAST((o_orderkey % 192) // 8 AS VARCHAR) AS facility, CAST((o_orderkey % 192) % 8 AS VARCHAR) AS severity, 'host-' || o_custkey AS hostname, 'app' AS appname, CAST(o_orderkey AS VARCHAR) AS procid, o_orderpriority AS body FROM orders",
        "syslog_ietf": "SELECT o_orderkey, CAST((o_orderkey % 192) % 8 AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS appname, CAST(o_custkey AS VARCHAR) AS procid, o_orderstatus AS st, 'x y' AS pr, o_orderpriority AS body FROM orders",
        "cef_decode": "SELECT s_suppkey, 'A|B' AS vendor, s_name AS product, 'eq=ual and more' AS msg, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier",
        "leef_decode": "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS event_id, p_name AS name, CAST(p_size AS VARCHAR) AS size, 'a=b' AS eq FROM part",
        "json_flatten": "SELECT event_id, event_type AS c, '2' AS n, json_extract_string(props, '$.k') AS k FROM events",
        "xml_flatten": "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS key, 'a & b' AS first, CAST(p_size AS VARCHAR) AS second FROM part",
        "regex_alternatives": "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN '0' WHEN 'A' THEN '1' ELSE '2' END AS matched, CAST(l_orderkey AS VARCHAR) AS key, CASE WHEN l_returnflag = 'A' THEN 'order' END AS what FROM lineitem",
        "generic_pairs": "SELECT event_id, CAST(user_id AS VARCHAR) AS ab, 'x y' AS q, event_type AS t, CAST(6 AS INT) AS severity FROM events",
        "mapping": _MAPPED,
        "mapping_columns": _MAPPED,
        "identify_priority": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'checkpoint-firewall' WHEN 1 THEN 'generic-cef-network' WHEN 2 THEN 'fortinet-fortigate-traffic' WHEN 3 THEN 'linux-syslog-host' END AS pack_id FROM events",
        "flows": f"""SELECT pack_id, activity_id, count(*) AS n, count(DISTINCT CASE WHEN told AND src_ip <> '' THEN src_ip WHEN line LIKE '%192.0.2.7%' THEN '192.0.2.7' END) AS n_src FROM {_WRITTEN} WHERE pack_id IS NOT NULL GROUP BY 1, 2""",
        "by_pack": f"SELECT pack_id, count(*) AS n FROM {_WRITTEN} WHERE pack_id IS NOT NULL GROUP BY 1",
        "dead_letters": f"SELECT 'unidentified' AS disposition, 'utf-8' AS raw_encoding, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM {_WRITTEN} WHERE pack_id IS NULL",
        "stats": f"""SELECT count(*) AS received, count(pack_id) AS parsed, count(*) - count(pack_id) AS unidentified, CAST(0 AS BIGINT) AS extract_failed, CAST(0 AS BIGINT) AS normalize_failed, CAST(sum(strlen(line)) AS BIGINT) AS bytes_in,
 count(*) FILTER (pack_id IS NULL AND src_ip <> '') AS searchable_unidentified, round(count(pack_id) / count(*), 6) AS coverage FROM {_WRITTEN}""",
        "feature_rows": f"""SELECT CAST(p.src_is_private AS BIGINT) AS src_is_private, CAST(p.dst_is_private AS BIGINT) AS dst_is_private, CASE WHEN t > 0 THEN (t // 3600000000000) % 24 ELSE -1 END AS hour_of_day,
 CASE WHEN t > 0 THEN (t // 86400000000000 + 3) % 7 ELSE -1 END AS day_of_week, count(*) AS n, CAST(sum(src_port) AS BIGINT) AS ports, CAST(0 AS BIGINT) AS alerts
 FROM (SELECT *, CASE WHEN abs(time_ns) < 100000000000 THEN time_ns * 1000000000 WHEN abs(time_ns) < 100000000000000 THEN time_ns * 1000000 WHEN abs(time_ns) < 100000000000000000 THEN time_ns * 1000 ELSE time_ns END AS t FROM {_FLOW}) JOIN (SELECT DISTINCT event_uid, src_is_private, dst_is_private FROM features) p USING (event_uid) GROUP BY 1, 2, 3, 4""",
        "chain_tampered": """SELECT event_id % 50 <> 0 AS own_ok, before IS NULL OR before % 70 <> 0 AS link_ok, count(*) AS n
 FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS before FROM events) WHERE event_id % 70 <> 0 GROUP BY 1, 2""",
        "clusters": """SELECT printf('C%04d', row_number() OVER (ORDER BY min(event_id))) AS cluster_id, CAST(6 + event_id % 3 AS INT) AS n_tokens, min(event_id) AS first_seq,
 '<*> by user <*> no <*>' || repeat(' pad', CAST(event_id % 3 AS INT)) AS template, count(*) AS n, round((3 + event_id % 3) / (6 + event_id % 3), 6) AS specificity FROM events GROUP BY event_id % 3""",
        "evidence_run": f"SELECT count(*) AS n_events, CAST(0 AS BIGINT) AS n_bad, count(*) AS n_leaves, CAST(64 AS INT) AS root_digits FROM {_FLOW}",
        "event_rows": """SELECT DISTINCT locator, pack, disposition, j->>'$.metadata.uid' AS uid, try_cast(j->>'$.class_uid' AS BIGINT) AS class_uid, try_cast(j->>'$.type_uid' AS BIGINT) AS type_uid,
 try_cast(j->>'$.severity_id' AS BIGINT) AS severity_id, j->>'$.src_endpoint.ip' AS src_ip, try_cast(j->>'$.dst_endpoint.port' AS BIGINT) AS dst_port FROM (SELECT locator, pack, disposition, event_json::JSON AS j FROM recent_events)""",
        "vault_index": "SELECT o_orderkey % 2 AS segment, o_orderkey % 2 = 0 AS sealed, count(*) AS n, CAST(sum(strlen(o_orderpriority)) AS BIGINT) AS bytes FROM orders GROUP BY 1, 2",
        "vault_offsets": f"""SELECT o_orderkey AS seq, o AS "offset", n AS len, CASE o_orderpriority {_crc("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")} END AS crc32,
 'vault:raw:' || lpad(lower(to_hex(3)), 16, '0') || ':' || lpad(lower(to_hex(o)), 16, '0') || ':' || lpad(lower(to_hex(n)), 8, '0') AS locator
 FROM (SELECT *, CAST(strlen(o_orderpriority) AS BIGINT) AS n, CAST(coalesce(sum(strlen(o_orderpriority)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM orders)""",
        "fixture_report": f"SELECT * FROM (VALUES {', '.join(f'({p.id!r}, {len(p.fixtures)}, {len(p.fixtures)}, {a}, {a})' for p in packs() for a in [sum(len(f.get('expect') or {}) for f in p.fixtures)])}) t(pack, fixtures, passed, assertions, assertions_passed)",
        "merkle": """WITH RECURSIVE t AS (SELECT 0 AS k, row_number() OVER (ORDER BY raw_id) - 1 AS i, sha256('\\x00'::BLOB || coalesce(raw, ''::BLOB)) AS h, count(*) OVER () AS n FROM raw_events
 UNION ALL SELECT k + 1, i // 2, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(max(h) FILTER (i % 2 = 0)) || unhex(max(h) FILTER (i % 2 = 1))) ELSE max(h) END, (n + 1) // 2 FROM t WHERE n > 1 GROUP BY k, i // 2, n)
 SELECT h AS root, (SELECT count(*) FROM raw_events) AS n FROM t WHERE n = 1""",
        "salvage_found": f"SELECT * FROM ({_SALVAGED})",
        "coercions": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN '7.5' WHEN 3 THEN 'Yes' END AS present, CASE WHEN event_id % 4 = 0 THEN user_id END AS as_int, CASE WHEN event_id % 4 = 3 THEN true WHEN event_id % 4 = 0 AND user_id IN (0, 1) THEN user_id = 1 END AS as_bool FROM events",
        "times": """SELECT o_orderkey, epoch(o_orderdate)::BIGINT * 1000000000 AS epoch_s, epoch(o_orderdate)::BIGINT * 1000000000 AS epoch_ms, (epoch(o_orderdate)::BIGINT - 7200) * 1000000000 + 123456789 AS rfc3339,
 epoch(date_trunc('minute', o_orderdate))::BIGINT * 1000000000 AS date_time, epoch(o_orderdate)::BIGINT * 1000000000 AS slash_date_time, (epoch(o_orderdate)::BIGINT + 5400) * 1000000000 AS clf,
 (epoch(make_date(2024, month(o_orderdate)::INT, day(o_orderdate)::INT)::TIMESTAMP)::BIGINT + 1) * 1000000000 AS rfc3164, CAST(NULL AS BIGINT) AS bad FROM orders""",
        "locators": "SELECT l_orderkey, l_linenumber, 'vault:raw:' || lpad(lower(to_hex(l_orderkey)), 16, '0') || ':' || lpad(lower(to_hex(l_partkey)), 16, '0') || ':' || lpad(lower(to_hex(l_linenumber)), 8, '0') AS locator, l_partkey AS back FROM lineitem",
        "raw_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
        "chain_verify": "SELECT 'chain-' || (user_id % 20) AS chain_uid, count(*) AS n_events, CAST(0 AS BIGINT) AS n_bad, true AS ok FROM events GROUP BY 1",
        "merkle_level": """WITH l AS (SELECT c_custkey - 1 AS i, sha256('\\x00'::BLOB || encode(c_name)) AS h FROM customer)
 SELECT a.i // 2 AS idx, CASE WHEN b.h IS NULL THEN a.h ELSE sha256('\\x01'::BLOB || unhex(a.h) || unhex(b.h)) END AS h FROM l a LEFT JOIN l b ON b.i = a.i + 1 WHERE a.i % 2 = 0""",
        "private_flags": "SELECT src_is_private AS computed, src_is_private, count(*) AS n FROM features GROUP BY 1, 2",
        "templates": "SELECT event_id, 'user ' || lower(event_type) || ' id=<value> at <ip> n <number>' AS template FROM events",
        "recent": "SELECT raw_id, locator, transport FROM raw_events ORDER BY raw_id DESC LIMIT 500",
    }
