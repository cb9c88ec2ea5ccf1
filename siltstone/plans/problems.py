"""Queries pN_ of the general problems, and their SQL where SQL can say it on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import featureblocks, loglines, rejects, shred, timestamps, watermark
from ..session import table
from . import rejects_sql


#: Classes of the flat feature table: each with every severity.
WIDE_CLASSES, WIDE_SEVERITIES = (-1, 0, 1001, 1003, 1008, 2004, 3002, 4001, 4002, 4009, 6003), (-1, 0, 1, 2, 3, 4, 5, 6, 99)


def _entity(kind: str, *fields: str):
    def run(spark, d):
        found = shred.attestation_entities(table(spark, d, "recent_events"), {kind: shred.ATTESTATION[kind]})
        return found.select("event_uid", "att_no", "child_no", *fields).distinct()

    return run


def _valid(spark, d):
    rows = rejects.sort_rows(table(spark, d, "dead_letters"), table(spark, d, "layouts")).where(F.col("reason").isNull())
    return rows.select("locator", "pack", F.inline("fields")).distinct()


def _wide(spark, d):
    """The totals and a set of columns for every type of the event contract, whether it occurs or not."""
    wide = featureblocks.entity_features(table(spark, d, "features"))
    return featureblocks.widen(wide, [(c, s) for c in WIDE_CLASSES for s in WIDE_SEVERITIES])


def _instants(spark, d):
    from ..operators.entries import assemble

    e = timestamps.with_zone(assemble(table(spark, d, "raw_events")), table(spark, d, "devices"))
    return timestamps.stated_instant(e, "text", "received_at", "source_zone").select("raw_id", "event_uid", "stated_ns", "stated_ns_format", "source_zone")


def queries():
    return {
        "p1_found": lambda s, d: shred.attestation_children(table(s, d, "recent_events")),
        "p1_attestations": _entity("attestation", "uid", "authority_uid", "chain_uid"),
        "p1_prev_events": _entity("prev_event", "uid", "type_uid"),
        "p1_fingerprints": _entity("fingerprint", "algorithm_id", "algorithm", "encoding_id", "serialization_id", "value"),
        "p1_signatures": _entity("signature", "algorithm_id", "algorithm", "created_time", "developer_uid", "digest_value"),
        "p3_found": lambda s, d: rejects.rejects(table(s, d, "dead_letters"), table(s, d, "recent_events"), table(s, d, "layouts")),
        "p3_valid": _valid,
        "p4_found": lambda s, d: timestamps.wrong_instants(table(s, d, "raw_events"), table(s, d, "devices"), table(s, d, "features")),
        "p4_instants": _instants,
        "p5_found": lambda s, d: loglines.found_entries(table(s, d, "raw_events"), table(s, d, "dead_letters")),
        "p5_entries": lambda s, d: loglines.parse_entries(loglines.all_entries(table(s, d, "raw_events"), table(s, d, "dead_letters"))).withColumn("unparsed", F.size("unparsed")),
        "p6_found": lambda s, d: watermark.refused(table(s, d, "envelopes"), table(s, d, "features")),
        "p6_hourly": lambda s, d: watermark.hourly(table(s, d, "envelopes"), table(s, d, "features")),
        "p6_diverted": lambda s, d: watermark.diverted(table(s, d, "envelopes"), table(s, d, "features")),
        "p6_corrections": lambda s, d: watermark.corrections(table(s, d, "envelopes"), table(s, d, "features")),
        "p7_features": lambda s, d: featureblocks.entity_features(table(s, d, "features")),
        "p7_wide": _wide,
        "p7_listed": lambda s, d: featureblocks.listed(featureblocks.entity_features(table(s, d, "features"))),
    }


_ATT = """
doc AS (SELECT DISTINCT event_uid, CASE WHEN json_type(event_json) = 'VARCHAR' THEN json_extract_string(event_json, '$')::JSON ELSE event_json::JSON END AS j FROM recent_events),
lst AS (SELECT event_uid, CASE json_type(j, '$.attestation_list') WHEN 'ARRAY' THEN CAST(j->'$.attestation_list' AS JSON[]) WHEN 'OBJECT' THEN [j->'$.attestation_list'] ELSE [] END AS l FROM doc),
att AS (SELECT event_uid, i - 1 AS att_no, l[i] AS a FROM (SELECT event_uid, l, unnest(range(1, len(l) + 1)) AS i FROM lst) WHERE json_type(l[i]) = 'OBJECT'),
sgl AS (SELECT event_uid, att_no, CASE json_type(a, '$.signatures') WHEN 'ARRAY' THEN CAST(a->'$.signatures' AS JSON[]) WHEN 'OBJECT' THEN [a->'$.signatures'] ELSE [] END AS l FROM att),
sig AS (SELECT event_uid, att_no, i - 1 AS child_no, l[i] AS g FROM (SELECT event_uid, att_no, l, unnest(range(1, len(l) + 1)) AS i FROM sgl) WHERE json_type(l[i]) = 'OBJECT')
"""
_RECEIPT = """CASE WHEN abs(received_at) < 100000000000 THEN received_at * 1000000000 WHEN abs(received_at) < 100000000000000 THEN received_at * 1000000
 WHEN abs(received_at) < 100000000000000000 THEN received_at * 1000 ELSE received_at END"""
_JUDGED = f"""
r AS (SELECT event_uid, min({_RECEIPT}) AS f FROM envelopes WHERE event_uid IS NOT NULL AND received_at IS NOT NULL GROUP BY 1),
e AS (SELECT event_uid, max(time_ns) AS time_ns, max(pack_id) AS pack_id FROM features GROUP BY 1),
x AS (SELECT event_uid, pack_id, f, (time_ns - (time_ns % 3600000000000 + 3600000000000) % 3600000000000) // 1000000000 AS hour_start FROM e JOIN r USING (event_uid) WHERE time_ns <> -1)
"""
_ONCE = "e AS (SELECT event_uid, min(src_ip) AS src_ip, min(class_uid) AS class_uid, min(severity_id) AS severity_id, min(time_ns) AS time_ns FROM (SELECT DISTINCT event_uid, src_ip, class_uid, severity_id, time_ns FROM features WHERE src_ip <> '') GROUP BY 1)"
# Closing instants from their definition, per source and hour by as-of joins: a source counts where its last clock before
# end + lateness is younger than the time-out, and holds the hour up to its next clock, at most for the time-out.
_CLOSED = f"""WITH {_JUDGED},
c AS (SELECT DISTINCT coalesce(receiver_id, '') AS source, {_RECEIPT} AS t FROM envelopes WHERE received_at IS NOT NULL),
h AS (SELECT source, hour_start, (hour_start + 5400) * 1000000000 AS due FROM (SELECT DISTINCT hour_start FROM x), (SELECT DISTINCT source FROM c)),
b AS (SELECT h.source, h.hour_start, h.due, c.t AS last_t FROM h ASOF JOIN c ON h.source = c.source AND h.due >= c.t),
a AS (SELECT b.*, c.t AS next_t FROM b ASOF LEFT JOIN c ON b.source = c.source AND b.due <= c.t),
k AS (SELECT hour_start, max(least(coalesce(next_t, due + 900000000000), due + 900000000000)) AS close_ns FROM a WHERE last_t > due - 900000000000 GROUP BY 1),
j AS (SELECT x.*, coalesce(close_ns, (hour_start + 5400) * 1000000000) AS close_ns FROM x LEFT JOIN k USING (hour_start)),
o AS (SELECT *, CASE WHEN f <= close_ns THEN 'in_time' WHEN f <= (hour_start + 25200) * 1000000000 THEN 'corrected' ELSE 'refused' END AS outcome FROM j)
"""


def oracle_sql():
    return {
        "p1_found": f"""WITH {_ATT}
SELECT DISTINCT event_uid, CAST(att_no AS INT) AS att_no, kind, CAST(child_no AS INT) AS child_no, child_value FROM (
 SELECT event_uid, att_no, 'prev_event' AS kind, 0 AS child_no, a->>'$.prev_event.uid' AS child_value FROM att WHERE json_type(a, '$.prev_event') = 'OBJECT'
 UNION ALL SELECT event_uid, att_no, 'prev_fingerprint', 0, a->>'$.prev_event.fingerprint.value' FROM att WHERE json_type(a, '$.prev_event.fingerprint') = 'OBJECT'
 UNION ALL SELECT event_uid, att_no, 'fingerprint', 0, a->>'$.fingerprint.value' FROM att WHERE json_type(a, '$.fingerprint') = 'OBJECT'
 UNION ALL SELECT event_uid, att_no, 'signature', child_no, coalesce(g->>'$.digest.value', '') FROM sig)""",
        "p1_attestations": f"WITH {_ATT} SELECT DISTINCT event_uid, CAST(att_no AS INT) AS att_no, CAST(0 AS INT) AS child_no, a->>'$.uid' AS uid, a->>'$.authority_uid' AS authority_uid, a->>'$.chain_uid' AS chain_uid FROM att",
        "p1_prev_events": f"WITH {_ATT} SELECT DISTINCT event_uid, CAST(att_no AS INT) AS att_no, CAST(0 AS INT) AS child_no, a->>'$.prev_event.uid' AS uid, a->>'$.prev_event.type_uid' AS type_uid FROM att WHERE json_type(a, '$.prev_event') = 'OBJECT'",
        "p1_fingerprints": f"WITH {_ATT} SELECT DISTINCT event_uid, CAST(att_no AS INT) AS att_no, CAST(0 AS INT) AS child_no, a->>'$.fingerprint.algorithm_id' AS algorithm_id, a->>'$.fingerprint.algorithm' AS algorithm, a->>'$.fingerprint.encoding_id' AS encoding_id, a->>'$.fingerprint.serialization_id' AS serialization_id, a->>'$.fingerprint.value' AS value FROM att WHERE json_type(a, '$.fingerprint') = 'OBJECT'",
        "p1_signatures": f"WITH {_ATT} SELECT DISTINCT event_uid, CAST(att_no AS INT) AS att_no, CAST(child_no AS INT) AS child_no, g->>'$.algorithm_id' AS algorithm_id, g->>'$.algorithm' AS algorithm, g->>'$.created_time' AS created_time, g->>'$.developer_uid' AS developer_uid, g->>'$.digest.value' AS digest_value FROM sig",
        "p3_found": rejects_sql.FOUND,
        "p3_valid": rejects_sql.VALID,
        "p6_found": f"WITH {_JUDGED} SELECT event_uid, hour_start FROM x WHERE f > (hour_start + 25200) * 1000000000",
        "p6_hourly": f"""{_CLOSED} SELECT hour_start, pack_id, max(close_ns) AS close_ns, count(*) FILTER (outcome = 'in_time') AS n_at_close, count(*) FILTER (outcome <> 'refused') AS n_final,
 count(*) FILTER (outcome <> 'in_time') AS n_diverted, count(*) FILTER (outcome = 'refused') AS n_refused FROM o GROUP BY 1, 2""",
        "p6_diverted": f"{_CLOSED} SELECT event_uid, pack_id, hour_start, close_ns, f AS first_ns, outcome FROM o WHERE outcome <> 'in_time'",
        "p6_corrections": f"""{_CLOSED} SELECT hour_start, pack_id, close_ns + step * 900000000000 AS published_ns, CAST(row_number() OVER w - 1 AS INT) AS version, CAST(sum(n) OVER w AS BIGINT) AS n_events
 FROM (SELECT hour_start, pack_id, close_ns, CASE WHEN outcome = 'in_time' THEN 0 ELSE (f - close_ns + 899999999999) // 900000000000 END AS step, count(*) AS n FROM o WHERE outcome <> 'refused' GROUP BY ALL)
 WINDOW w AS (PARTITION BY hour_start, pack_id ORDER BY step)""",
        "p7_features": f"""WITH {_ONCE}, t AS (SELECT src_ip, class_uid, severity_id, count(*) AS n, max(time_ns) AS last_time_ns, CAST(sum(severity_id) AS BIGINT) AS severity_total FROM e GROUP BY ALL),
b AS (SELECT *, ((class_uid // 1000) % 8 + 8) % 8 AS k, {{'class_uid': class_uid, 'severity_id': severity_id, 'n': n, 'last_time_ns': last_time_ns, 'severity_total': severity_total}} AS one FROM t)
SELECT src_ip, CAST(sum(n) AS BIGINT) AS n, max(last_time_ns) AS last_time_ns, CAST(sum(severity_total) AS BIGINT) AS severity_total, {", ".join(f"coalesce(list(one ORDER BY class_uid, severity_id) FILTER (k = {k}), []) AS block_{k}" for k in range(8))} FROM b GROUP BY 1""",
        "p7_wide": f"""WITH {_ONCE} SELECT src_ip, {", ".join(f"count(*) FILTER (class_uid = {c} AND severity_id = {s}) AS n_{x}, max(time_ns) FILTER (class_uid = {c} AND severity_id = {s}) AS last_{x}, coalesce(CAST(sum(severity_id) FILTER (class_uid = {c} AND severity_id = {s}) AS BIGINT), 0) AS total_{x}" for c in WIDE_CLASSES for s in WIDE_SEVERITIES for x in [f"{c}_{s}".replace("-", "m")])} FROM e GROUP BY 1""",
        "p7_listed": """SELECT src_ip, class_uid, severity_id, count(*) AS n, max(time_ns) AS last_time_ns, CAST(sum(severity_id) AS BIGINT) AS severity_total
 FROM (SELECT DISTINCT event_uid, src_ip, class_uid, severity_id, time_ns FROM features WHERE src_ip <> '') GROUP BY 1, 2, 3""",
    }
