"""SQL of problem 3: fields by expressions over the record with a delimiter at its end, kinds by expressions and casts."""

from __future__ import annotations

_HEX, _BYTE = "[0-9A-Fa-f]{1,4}", "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"({_BYTE}\.){{3}}{_BYTE}"


def _groups(n: int) -> str:
    """Up to ``n`` groups."""
    return f"(({_HEX}:){{0,{n - 1}}}{_HEX})?" if n else ""


def _ipv6() -> str:
    """Eight groups, the last two also as IPv4; two or more groups of zeros may be written as ``::``."""
    last = f"({_HEX}:{_HEX}|{_V4})"
    whole = f"({_HEX}:){{6}}{last}"
    short = [f"{_groups(n)}::({_HEX}:){{{5 - n}}}{last}" for n in range(6)]
    return "|".join([whole, *short, f"{_groups(6)}::{_HEX}", f"{_groups(7)}::"])


_FIELDS = rf"""WITH
lay AS (SELECT pack_id, any_value(delim) AS d, any_value(quote_char) AS q, count(*) AS n_cols FROM layouts GROUP BY 1),
bare AS (SELECT locator, pack, regexp_replace(coalesce(raw_text, ''), '\r?\n\z', '') AS t, d, q, n_cols, '[' || CASE WHEN d = '\' THEN '\\' ELSE d END || ']' AS x, '[^"' || d || ']*' AS plain
 FROM (SELECT DISTINCT locator, pack, raw_text FROM dead_letters WHERE pack IS NOT NULL) JOIN lay ON pack = pack_id),
cut AS (SELECT *, q IS NULL OR regexp_full_match(t || d, '(?s)(("([^"]|"")*"|' || plain || ')' || x || ')+') AS sound FROM bare),
rec AS (SELECT *, CASE WHEN NOT sound THEN NULL WHEN q IS NULL THEN string_split(t, d)
 ELSE list_transform(regexp_extract_all(t || d, '(?s)("([^"]|"")*"|' || plain || ')' || x), lambda f: CASE WHEN f[1] = '"' THEN replace(f[2:-3], '""', '"') ELSE f[1:-2] END) END AS f FROM cut),
cell AS (SELECT locator, pack, t, col_no, col_name, kind, is_optional, f[col_no + 1] AS v FROM rec JOIN layouts ON pack = pack_id WHERE sound AND len(f) = n_cols AND NOT (t = '' AND n_cols > 1)),
fit AS (SELECT *, (coalesce(is_optional, false) AND v IN ('', '-')) OR CASE
 WHEN kind = 'ip' THEN regexp_full_match(v, '{_V4}|{_ipv6()}')
 WHEN kind = 'port' THEN regexp_full_match(v, '0*[0-9]{{1,5}}') AND coalesce(try_cast(v AS BIGINT), 99999) <= 65535
 WHEN kind = 'count' THEN regexp_full_match(v, '[0-9]+') AND length(ltrim(v, '0')) <= 19 AND try_cast('0' || ltrim(v, '0') AS BIGINT) IS NOT NULL
 WHEN kind = 'epoch' THEN regexp_full_match(v, '[0-9]+(\.[0-9]+)?')
 WHEN kind = 'stamp' THEN regexp_full_match(v, '[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND try_strptime(v, '%Y/%m/%d %H:%M:%S') IS NOT NULL
 WHEN kind = 'word' THEN regexp_full_match(v, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+')
 WHEN starts_with(kind, 'enum:') THEN list_contains(string_split(kind[6:], '|'), v) ELSE true END AS ok FROM cell),
bad AS (SELECT DISTINCT locator, pack, t FROM fit WHERE NOT ok)
"""

FOUND = f"""{_FIELDS} SELECT locator, 'quoting' AS reason FROM rec WHERE NOT sound
 UNION SELECT locator, 'columns' FROM rec WHERE sound AND (len(f) <> n_cols OR t = '' AND n_cols > 1)
 UNION SELECT locator, 'value' FROM bad
 UNION SELECT locator, 'layout' FROM dead_letters WHERE pack IS NOT NULL AND pack NOT IN (SELECT pack_id FROM layouts)
 UNION SELECT locator, 'disposition' FROM recent_events
  WHERE coalesce(disposition, '') NOT IN ('parsed', 'unidentified', 'extract_failed', 'normalize_failed') OR (pack IS NULL) <> (disposition = 'unidentified')"""

VALID = f"""{_FIELDS} SELECT DISTINCT f.locator, f.pack, CAST(col_no AS INT) AS col_no, col_name, kind, v AS text, CASE WHEN kind IN ('port', 'count') THEN try_cast(v AS BIGINT) END AS whole,
 CASE WHEN kind = 'epoch' THEN try_cast(v AS DOUBLE) END AS real, CASE WHEN kind = 'stamp' THEN CAST(epoch(try_strptime(v, '%Y/%m/%d %H:%M:%S')) AS BIGINT) * 1000000000 END AS stamp_ns
 FROM fit f ANTI JOIN bad b ON f.locator IS NOT DISTINCT FROM b.locator AND f.pack = b.pack AND f.t = b.t"""
