"""Queries pN_ of the problems on identifiers and texts, and their SQL."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import functions as F

from ..session import table
from . import bitmaps, bpe, leakage, truncation


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary's file: in the folder named by ``SILTSTONE_TOKENIZERS``, else beside the installed ``public_tokenizers``, else in /opt/tokenizers."""
    folder = os.environ.get("SILTSTONE_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def _halves(features):
    """All rows as two runs would have seen them."""
    half = F.pmod(F.xxhash64("event_uid"), F.lit(2))
    return [features.where(half == k) for k in range(2)]


def queries():
    return {
        "p2_distinct": lambda s, d: bitmaps.cube(table(s, d, "features")),
        "p2_runs": lambda s, d: bitmaps.cube_of_runs(_halves(table(s, d, "features"))),
        "p2_returning": lambda s, d: bitmaps.returning(table(s, d, "features")),
        "p8_ids": lambda s, d: bpe.encode_documents(table(s, d, "documents"), vocabulary_path()),
        "p8_texts": lambda s, d: bpe.decode_documents(bpe.encode_documents(table(s, d, "documents"), vocabulary_path()), vocabulary_path()),
        "p9_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_spans": lambda s, d: leakage.leaked_spans(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_scrubbed": lambda s, d: leakage.scrub_passages(table(s, d, "documents"), table(s, d, "eval_items")),
        "p10_found": lambda s, d: truncation.found(table(s, d, "documents")),
        "p10_lengths": lambda s, d: truncation.lengths(table(s, d, "documents")),
        "p10_limits": lambda s, d: truncation.limits(truncation.lengths(table(s, d, "documents"))),
        "p10_at_limits": lambda s, d: truncation.at_limits(table(s, d, "documents")),
        "p10_rates": lambda s, d: truncation.rates(table(s, d, "documents")),
    }


_LEVEL = "CASE WHEN g = 7 THEN 'all' ELSE concat_ws('+', CASE WHEN g & 4 = 0 THEN 'day' END, CASE WHEN g & 2 = 0 THEN 'pack_id' END, CASE WHEN g & 1 = 0 THEN 'class_uid' END) END"


_LENGTHS = """l AS (SELECT source, 'text' AS "column", measure, length, count(*) AS n FROM (
 SELECT coalesce(source, '') AS source, unnest(['chars', 'bytes']) AS measure, unnest([length(text), strlen(text)]) AS length FROM documents WHERE regexp_matches(text, '\\S')) GROUP BY ALL)"""
_LIMITS = f"""{_LENGTHS}, w AS (SELECT *, sum(n) OVER (PARTITION BY source, measure) AS total,
  (SELECT coalesce(sum(n), 0) FROM l o WHERE o.source = l.source AND o.measure = l.measure AND abs(o.length - l.length) BETWEEN 4 AND 40) / 74 AS density,
  (SELECT coalesce(sum(n), 0) FROM l o WHERE o.source = l.source AND o.measure = l.measure AND o.length > l.length + 3) AS above FROM l),
 lim AS (SELECT source, "column", measure, length, n FROM w WHERE n >= 5 AND n >= 0.01 * total AND n >= 5 * density AND above <= 0.02 * total)"""
_CUBE = f"""SELECT {_LEVEL} AS level, day, pack_id, class_uid, n_src_ip, n_dst_ip, n_ip, CAST(0 AS BIGINT) AS error_bound FROM (
 SELECT grouping(day, pack_id, class_uid) AS g, day, pack_id, class_uid, count(DISTINCT a) FILTER (s = 1) AS n_src_ip, count(DISTINCT a) FILTER (s = 2) AS n_dst_ip, count(DISTINCT a) AS n_ip
 FROM (SELECT CAST(floor(epoch_seconds / 86400) AS INT) AS day, pack_id, class_uid, src_ip AS a, 1 AS s FROM features WHERE src_ip <> ''
  UNION ALL SELECT CAST(floor(epoch_seconds / 86400) AS INT), pack_id, class_uid, dst_ip, 2 FROM features WHERE dst_ip <> '')
 GROUP BY CUBE (day, pack_id, class_uid))"""


def oracle_sql():
    return {
        "p10_lengths": f"WITH {_LENGTHS} SELECT * FROM l",
        "p10_limits": f"WITH {_LIMITS} SELECT * FROM lim",
        "p10_at_limits": f"""WITH {_LIMITS}, t AS (SELECT coalesce(source, '') AS source, length(text) AS c, strlen(text) AS b,
  regexp_matches(text, '[.!?。！？｡؟।‼⁇⁈⁉][\\p{{Pe}}\\p{{Pf}}"''`*_]*[\\s\\p{{Z}}]*$') AND NOT regexp_matches(text, '(\\.\\.\\.|…)[\\p{{Pe}}\\p{{Pf}}"''`*_]*[\\s\\p{{Z}}]*$') AS ended FROM documents WHERE regexp_matches(text, '\\S')),
 p AS (SELECT t.*, EXISTS (SELECT 1 FROM lim WHERE lim.source = t.source AND (measure = 'chars' AND lim.length = c OR measure = 'bytes' AND b BETWEEN lim.length - 2 AND lim.length)) AS hit FROM t)
 SELECT source, count(*) AS n_texts, count(*) FILTER (hit) AS n_at_limit, count(*) FILTER (hit AND NOT ended) AS n_cut_at_limit FROM p GROUP BY 1""",
        "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p2_distinct": _CUBE,
        "p2_runs": _CUBE,
        "p2_returning": """WITH o AS (SELECT DISTINCT CAST(floor(epoch_seconds / 86400) AS INT) AS day, src_ip AS a, 1 AS s FROM features WHERE src_ip <> ''
  UNION SELECT CAST(floor(epoch_seconds / 86400) AS INT), dst_ip, 2 FROM features WHERE dst_ip <> '')
 SELECT n.day, count(*) FILTER (n.s = 1) AS n_src_ip, count(*) FILTER (n.s = 2) AS n_dst_ip FROM o n JOIN o p ON p.day = n.day - 1 AND p.a = n.a AND p.s = n.s GROUP BY 1""",
    }
