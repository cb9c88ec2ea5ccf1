"""The normalisation pipeline fused into one Arrow stage.

Same events as ``normalise`` builds from column expressions, row by row over Arrow batches:
with dozens of packs the column plan takes long to build and spends its time in interpreted
lambdas, so this is the default. Packs are compiled once per task. No shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..decode import MAX_FIELDS, MAX_KEY, MAX_VALUE, _flat_json, _flat_xml
from ..decode.salvage import MAX_FOUND
from ..functions.times import EPOCHS
from ..functions.values import EMPTY_MARKERS, FALSE_WORDS, OBSERVABLE_IDS, TRUE_WORDS
from ..packs.spec import Pack
from .normalise import ENVELOPE, RECEIPT, VERSION

_MARKERS = frozenset(EMPTY_MARKERS)
_MON = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
_INT = re.compile(r"[+-]?[0-9]+\Z")
_EPOCH0 = datetime(1970, 1, 1, tzinfo=timezone.utc)

# --- values ---------------------------------------------------------------------------------


def absent(v: str | None) -> bool:
    return v is None or v.strip(" ").lower() in _MARKERS


def to_int(v: str) -> int | None:
    s = v.strip(" ")
    if not _INT.match(s):
        return None
    n = int(s)
    return n if -(1 << 63) <= n < 1 << 63 else None


def to_float(v: str) -> float | None:
    try:
        return float(v.strip())
    except ValueError:
        return None


def to_bool(v: str) -> bool | None:
    s = v.strip().lower()
    return True if s in TRUE_WORDS else False if s in FALSE_WORDS else None


_FORMATS = {
    "rfc3339": re.compile(r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)[Tt ](?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)(?:\.(?P<f>\d+))?(?P<z>[Zz]|[+-]\d\d:\d\d)\Z"),
    "date_time": re.compile(r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)[ T](?P<H>\d\d):(?P<M>\d\d)(?::(?P<S>\d\d))?(?:\.(?P<f>\d+))?Z?\Z"),
    "slash_date_time": re.compile(r"(?P<y>\d{4})/(?P<m>\d\d)/(?P<d>\d\d)[ T](?P<H>\d\d):(?P<M>\d\d)(?::(?P<S>\d\d))?(?:\.(?P<f>\d+))?Z?\Z"),
    "rfc3164": re.compile(r"(?P<m>[A-Z][a-z]{2})\s+(?P<d>\d{1,2})\s+(?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)\Z"),
    "clf": re.compile(r"\[?(?P<d>\d\d)/(?P<m>[A-Z][a-z]{2})/(?P<y>\d{4}):(?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)(?:\s(?P<z>[+-]\d{4}))?\]?\Z"),
}


def time_ns(value: str, fmt: str, year: int) -> int | None:
    if fmt in EPOCHS:
        n = to_int(value)
        n = None if n is None else n * EPOCHS[fmt]
        return n if n is not None and -(1 << 63) <= n < 1 << 63 else None
    found = _FORMATS[fmt].match(value.strip())
    return _instant(found.groupdict(), year) if found else None


def _instant(g: dict, year: int) -> int | None:
    try:
        month = _MON[g["m"]] if g["m"][0].isalpha() else int(g["m"])
        at = datetime(int(g.get("y") or year), month, int(g["d"]), int(g["H"]), int(g["M"]), int(g.get("S") or 0), tzinfo=timezone.utc)
    except (KeyError, ValueError):
        return None
    zone = (g.get("z") or "").replace(":", "")
    if len(zone) == 5:
        shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[3:5]))
        at = at + shift if zone[0] == "-" else at - shift
    return ((at - _EPOCH0) // timedelta(seconds=1)) * 1_000_000_000 + int((g.get("f") or "0").ljust(9, "0")[:9])


# --- decoders: text -> (fields, body) or None -------------------------------------------------

_PRI = re.compile(r"<(\d{1,3})>")
_STAMP = re.compile(r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d (?:\d\d:\d\d:\d\d|\d{4} \d\d:\d\d:\d\d)) ?")
_HOST = re.compile(r"([A-Za-z0-9._-]{1,255})(?: |\Z)")
_TAG = re.compile(r"(?=[^:]{1,40}:)([A-Za-z0-9._/-]+)(?:\[(\d*)\])?: ?")
_SD_BLOCK = re.compile(r'\[((?:[^\]"\\]|\\(?!")|"(?:[^"\\]|\\.)*+")*)\]')
_SD_PARAM = re.compile(r'\s([^\s="]+)="((?:[^"\\]|\\.)*)"')
_ESCAPE = re.compile(r"(?s)\\(.)")
_NAMED = {"n": "\n", "r": "\r", "t": "\t"}


def _unescape(s: str, named: bool = True) -> str:
    if "\\" not in s:
        return s
    return _ESCAPE.sub(lambda m: _NAMED.get(m.group(1), m.group(1)) if named else m.group(1), s)


def syslog(text: str, dialect: str = "auto"):
    line = text.rstrip("\r\n\0")
    if not line:
        return None
    fields: dict[str, str] = {}
    pri = _PRI.match(line)
    if pri and int(pri.group(1)) <= 191:
        n = int(pri.group(1))
        fields |= {"syslog.priority": str(n), "syslog.facility": str(n // 8), "syslog.severity": str(n % 8)}
        line = line[pri.end() :]
    elif dialect != "auto":
        return None
    if dialect == "rfc5424" or dialect == "auto" and re.match(r"\d{1,2} ", line):
        parts = line.split(" ", 6)
        for name, part in zip(("version", "timestamp", "hostname", "appname", "procid", "msgid"), parts):
            if part and part != "-":
                fields[f"syslog.{name}"] = part
        rest = parts[6] if len(parts) > 6 else ""
        if rest.startswith("-"):
            rest = rest[1:].removeprefix(" ")
        elif rest.startswith("["):
            at = 0
            while block := _SD_BLOCK.match(rest, at):
                name = block.group(1).split(" ", 1)[0]
                fields[f"syslog.sd.{name}"] = name
                for key, value in _SD_PARAM.findall(block.group(1)):
                    fields[f"syslog.sd.{name}.{key}"] = value
                at = block.end()
            if at == 0:
                return None
            rest = rest[at:].removeprefix(" ")
        body = rest.removeprefix("\ufeff")
    else:
        body = line
        if stamp := _STAMP.match(body):
            fields["syslog.timestamp"] = stamp.group(1)
            body = body[stamp.end() :]
            if host := _HOST.match(body):
                fields["syslog.hostname"] = host.group(1)
                body = body[host.end() :]
        if tag := _TAG.match(body):
            fields["syslog.appname"] = tag.group(1)
            if tag.group(2) is not None:
                fields["syslog.procid"] = tag.group(2)
            body = body[tag.end() :]
    fields["syslog.body"] = body
    return fields, body


def _pair_pattern(sep: str, delim: str) -> re.Pattern:
    s, d = re.escape(sep), re.escape(delim)
    return re.compile(rf'([^{d}{s}]*){s}(?:"((?:[^"\\]|\\.)*+)"|"([\s\S]*)|([^{d}]*))')


def keyvalue(pattern: re.Pattern, text: str):
    fields: dict[str, str] = {}
    for key, quoted, broken, bare in pattern.findall(text.strip()):
        key = key.strip()
        if key:
            fields[key] = _unescape(quoted) if quoted else broken or bare
    return (fields, None) if fields else None


def split_record(line: str, delim: str) -> list[str]:
    if '"' not in line:
        return line.split(delim)
    out, at = [], 0
    while True:
        if line.startswith('"', at):
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return [*out, line[at + 1 :]]
                if line.startswith('""', end):
                    end += 2
                    continue
                break
            out.append(line[at + 1 : end].replace('""', '"'))
            if not line.startswith(delim, end + 1):
                return out
            at = end + 1 + len(delim)
        else:
            end = line.find(delim, at)
            if end < 0:
                return [*out, line[at:]]
            out.append(line[at:end])
            at = end + len(delim)


def delimited(delim: str, headers: list[str], text: str):
    line = text.rstrip("\r\n")
    if not line:
        return None
    columns = split_record(line, delim)
    fields: dict[str, str] = {}
    for name, value in zip(headers, columns):
        if name:
            fields.setdefault(name, value)
    for i, value in enumerate(columns):
        fields[f"col.{i}"] = value
    fields["col.count"] = str(len(columns))
    return fields, None


_CEF = re.compile(r"(?s)CEF:" + r"((?:[^|\\]|\\.)*)\|" * 7 + r"(.*)\Z")
_CEF_NAMES = ("cef.version", "cef.device_vendor", "cef.device_product", "cef.device_version", "cef.signature_id", "cef.name", "cef.severity")
_CEF_KEY = re.compile(r"(?:^| )((?:[^ =\\]|\\.)+)=")


def cef(text: str):
    found = _CEF.search(text.rstrip("\r\n"))
    if not found:
        return None
    fields = {n: _unescape(v, named=False) for n, v in zip(_CEF_NAMES, found.groups())}
    ext = found.group(8).lstrip()
    keys = list(_CEF_KEY.finditer(ext))
    pairs = {k.group(1).strip(): _unescape(ext[k.end() : keys[i + 1].start() if i + 1 < len(keys) else len(ext)].rstrip()) for i, k in enumerate(keys)}
    return pairs | fields, None


_LEEF_PAIR = re.compile(r"(?s)((?:[^=\\]|\\.)+)=(.*)\Z")


def leef(text: str):
    line = text.strip()
    if not line.startswith("LEEF:"):
        return None
    parts = line[5:].split("|", 4)
    if len(parts) < 5:
        return None
    version, vendor, product, release, rest = parts
    delim = "\t"
    if version.startswith("2") and "|" in rest:
        event, rest = rest.split("|", 1)
        mark, bar, after = rest.partition("|")
        if bar and (len(mark) == 1 or mark in ("", "0x09")):
            delim, rest = mark if len(mark) == 1 else "\t", after
    else:
        found = re.search(r"[\t|]", rest)
        event, rest = (rest[: found.start()], rest[found.end() :]) if found else (rest, "")
    fields = {}
    for part in rest.split(delim):
        if pair := _LEEF_PAIR.match(part.strip()):
            if key := pair.group(1).strip():
                fields[key] = _unescape(pair.group(2).strip())
    return fields | {"leef.version": version, "leef.vendor": vendor, "leef.product": product, "leef.product_version": release, "leef.event_id": event}, None


def named_groups(patterns: list[re.Pattern], text: str):
    line = text.rstrip("\r\n")
    for index, pattern in enumerate(patterns):
        if found := pattern.search(line):
            fields = {k: v for k, v in found.groupdict().items() if v}
            if len(patterns) > 1:
                fields["regex.matched"] = str(index)
            return fields, fields["body"] if "body" in fields else line
    return None


def flat(flatten, text: str):
    fields = flatten(text)
    return None if fields is None else (fields, None)


def step_function(step: dict):
    """The decoder of one step of a chain."""
    name = step["decoder"]
    if name.startswith("syslog"):
        dialect = {"syslog": "auto"}.get(name, name[7:])
        return lambda t: syslog(t, dialect)
    if name == "keyvalue":
        pattern = _pair_pattern(step.get("sep", "="), step.get("delim", " "))
        return lambda t: keyvalue(pattern, t)
    if name == "csv":
        delim, headers = step.get("delim", ","), step.get("headers") or []
        return lambda t: delimited(delim, headers, t)
    if name == "regex":
        patterns = [re.compile(re.sub(r"(?<!\\)\$$", r"\\Z", p)) for p in step["patterns"]]
        return lambda t: named_groups(patterns, t)
    return {"cef": cef, "leef": leef, "json": lambda t: flat(_flat_json, t), "xml": lambda t: flat(_flat_xml, t)}[name]


# --- lines without a pack, and indicators ------------------------------------------------------

_GENERIC = re.compile(r'([A-Za-z0-9_.-]+)=(?:"([^"]*)"|("[\s\S]*)|(\S*))')


def generic(text: str) -> dict[str, str]:
    pairs: list[tuple[str, str]] = []
    top = None
    if text.lstrip().startswith("{"):
        try:
            top = json.loads(text.strip(), parse_int=str, parse_float=lambda x: repr(float(x)))
        except (ValueError, RecursionError):
            top = None
    if isinstance(top, dict):
        pairs = [(k, ("true" if v else "false") if isinstance(v, bool) else v) for k, v in top.items() if v is not None and not isinstance(v, (dict, list))]
    else:
        pairs = [(k, q or b or w) for k, q, b, w in _GENERIC.findall(text)]
    out: dict[str, str] = {}
    for key, value in pairs:
        key, value = key.strip(), value.strip()
        if len(out) >= MAX_FIELDS:
            break
        if not key or not value or len(key.encode()) > MAX_KEY or key in out:
            continue
        out[key] = value if len(value) * 4 <= MAX_VALUE else value.encode("utf-8", "replace")[:MAX_VALUE].decode("utf-8", "ignore")
    return out


_BETWEEN = re.compile(r"[\s|,;()\[\]<>\"]+")
_IPV4 = re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\Z")
_HOSTNAME = re.compile(r"(?=.{4,253}\Z)(?!\.)(?!.*\.\.)[A-Za-z0-9._-]*\.[A-Za-z]{2,}\Z")
_EMAIL = re.compile(r"[A-Za-z0-9._+-]{1,64}@(?=[^@]{4,253}\Z)(?!\.)(?!.*\.\.)[A-Za-z0-9._-]*\.[A-Za-z]{2,}\Z")
_MAC = re.compile(r"(?:[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5})\Z")
_IPV6 = re.compile(r"(?=.{3})(?=[^:]*:[^:]*:)(?=.*::|.*[A-Fa-f])[0-9A-Fa-f:.]+\Z")
_PORT = re.compile(r"[0-9]{1,5}\Z")
_SCHEMES = ("http://", "https://", "ftp://")


def salvage(text: str) -> list[tuple[int, str]]:
    found: dict[tuple[int, str], None] = {}
    for token in _BETWEEN.split(text):
        if not any(c in token for c in ".:@-"):
            continue
        for one in _classify(token):
            found[one] = None
        if len(found) >= MAX_FOUND:
            break
    return sorted(list(found)[:MAX_FOUND])


def _classify(token: str):
    if token.startswith(_SCHEMES):
        return ((OBSERVABLE_IDS["url"], token),)
    key, eq, value = token.partition("=")
    c = (value if eq and value else token).strip("'\",;")
    if not c:
        return ()
    if c.startswith(_SCHEMES):
        return ((OBSERVABLE_IDS["url"], c),)
    if "@" in c and _EMAIL.match(c):
        return ((OBSERVABLE_IDS["email"], c),)
    if _MAC.match(c):
        return ((OBSERVABLE_IDS["mac"], c),)
    if ":" in c:
        if _IPV6.match(c):
            return ((OBSERVABLE_IDS["ip"], c),)
        host, _, port = c.rpartition(":")
        host = host.strip("[]")
        if host and _PORT.match(port) and 0 < int(port) <= 65535:
            for kind, pattern in (("ip", _IPV4), ("hostname", _HOSTNAME)):
                if pattern.match(host):
                    return ((OBSERVABLE_IDS[kind], host), (OBSERVABLE_IDS["port"], port))
    if _IPV4.match(c):
        return ((OBSERVABLE_IDS["ip"], c),)
    return ((OBSERVABLE_IDS["hostname"], c),) if _HOSTNAME.match(c) else ()


_TAIL = r"[\s\S]{15}\s*\S+\s+[A-Za-z0-9\-_./()]{1,%d}(?:\[\d*\])?:(?=\s|\Z)"
_SYSLOG_TAG = re.compile(r"\s*(?:<[^>]{0,3}>|(?!<))" + _TAIL % 32)
_CORPUS_TAG = re.compile(r"\s*\S+\s+\d{10}\s+\d{4}\.\d{2}\.\d{2}\s+\S+\s+" + _TAIL % 128)


def claimed(text: str, detect: list[dict]) -> bool:
    return any(
        d and all(x in text for x in d.get("contains_all") or ()) and (not d.get("contains_any") or any(x in text for x in d["contains_any"]))
        and not any(x in text for x in d.get("contains_none") or ()) and ("starts_with" not in d or text.startswith(d["starts_with"]))
        and (not d.get("syslog_tag") or _SYSLOG_TAG.match(text)) and (not d.get("loghub_syslog_prefix") or _CORPUS_TAG.match(text))
        and (d.keys() & {"contains_all", "contains_any", "starts_with", "syslog_tag", "loghub_syslog_prefix"})
        for d in detect
    )


_LEADING = [re.compile(p) for p in (
    r"(?:<\d{1,3}>)?(?:\d{1,2} )?\[?(?P<y>\d{4})[-/](?P<m>\d\d)[-/](?P<d>\d\d)[T ](?P<H>\d\d):(?P<M>\d\d)(?::(?P<S>\d\d))?(?:[.,](?P<f>\d+))?(?P<z>Z|[+-]\d\d:?\d\d)?",
    r"[^\[]*\[(?P<d>\d\d)/(?P<m>[A-Z][a-z]{2})/(?P<y>\d{4}):(?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)(?: (?P<z>[+-]\d{4}))?\]",
    r"(?:<\d{1,3}>)?(?P<m>[A-Z][a-z]{2}) +(?P<d>\d{1,2}) (?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)",
    r'\s*\{.*?"(?:ts|time|timestamp|@timestamp|eventTime|event_time)"\s*:\s*"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)[T ](?P<H>\d\d):(?P<M>\d\d)(?::(?P<S>\d\d))?(?:[.,](?P<f>\d+))?(?P<z>Z|[+-]\d\d:?\d\d)?',
)]


def leading_time(text: str, year: int) -> tuple[int | None, str]:
    """The time a line states, and whether its year was assumed."""
    for pattern in _LEADING:
        if found := pattern.match(text):
            g = found.groupdict()
            at = _instant(g, year)
            if at is not None:
                return at, "log" if g.get("y") else "log-year-assumed"
    return None, "receipt"


# --- the engine ---------------------------------------------------------------------------------

_OCSF_SEVERITY = (6, 5, 5, 4, 3, 2, 1, 1)


class Engine:
    """Compiled packs; ``event`` turns one record into one event."""

    def __init__(self, packs: list[Pack], year: int, inline_raw: bool = False, processed_at: int | None = None) -> None:
        self.year, self.inline_raw, self.processed_at = year, inline_raw, processed_at
        self.packs = [(p, [(step_function(s), bool(s.get("optional"))) for s in p.extract], sorted(p.map.items(), key=lambda kv: kv[0].count("."))) for p in packs]

    def value(self, pack: Pack, spec, fields: dict[str, str]):
        """``(value, winning field)`` of one mapping."""
        if not isinstance(spec, dict):
            return spec, None
        default = spec.get("default")
        names = spec["from"] if isinstance(spec["from"], list) else (spec["from"],)
        name = next((n for n in names if not absent(fields.get(n))), None)
        if name is None:
            return default, None
        v = fields[name]
        if spec.get("enum"):
            table = pack.enums[spec["enum"]]
            for key in (v, v.lower()):
                if key in table:
                    return table[key], name
            n = to_int(v)
            return (table.get(str(n), default) if n is not None else default), name
        if spec.get("format"):
            got = time_ns(v, spec["format"], self.year)
        else:
            got = {"int": to_int, "float": to_float, "bool": to_bool}.get(spec.get("as"), lambda x: x)(v)
        return (default if got is None else got), name

    def event(self, raw: bytes, received: int | None, locator: str | None, wanted: frozenset[str] = frozenset(), receipt: dict | None = None) -> dict:
        """The event of a record. With ``wanted`` only what these columns need is worked out; the others may be missing."""
        whole = not wanted
        searched = whole or bool(wanted & {"observables", "unmapped", "event_json"})
        text = raw.decode("utf-8", "replace")
        found = next(((p, steps, mapping) for p, steps, mapping in self.packs if claimed(text, p.detect)), None)
        fields: dict[str, str] | None = None
        error = None
        if found:
            fields, body = {}, text
            for decode, optional in found[1]:
                if body is None:
                    break
                got = decode(body)
                if got is None:
                    if not optional:
                        error = "a decoder of the chain does not apply"
                        break
                    continue
                fields = got[0] | fields
                body = got[1]
        values, used, seen = {}, set(), []
        if found and error is None:
            pack = found[0]
            for path, spec in found[2]:
                v, name = self.value(pack, spec, fields)
                if name:
                    used.add(name)
                if v is not None:
                    values[path] = v
                    if isinstance(spec, dict) and spec.get("observable") and isinstance(v, str):
                        seen.append((path, OBSERVABLE_IDS[spec["observable"]], v))
            is_int = lambda x: isinstance(x, int) and not isinstance(x, bool)
            activity, severity = values.get("activity_id"), values.get("severity_id", 1)
            if not is_int(values.get("class_uid")) or values["class_uid"] <= 0:
                error = "class_uid is missing or not positive"
            elif not is_int(activity) or not 0 <= activity <= 99:
                error = "activity_id is missing or out of range"
            elif severity not in (0, 1, 2, 3, 4, 5, 6, 99):
                error = "severity_id is out of range"
            disposition = "normalize_failed" if error else "parsed"
        else:
            disposition = "extract_failed" if found else "unidentified"
        parsed = disposition == "parsed"
        sha = hashlib.sha256(raw).hexdigest() if whole or wanted & {"raw_sha256", "event_uid", "event_json"} else ""
        unmapped: dict = {}
        if parsed:
            class_uid, activity, severity = values.pop("class_uid"), values.pop("activity_id"), values.pop("severity_id", 1)
            stated = values.pop("time", None)
            time, source = (stated, "log") if isinstance(stated, int) else (received, "receipt")
            rest = {k: v for k, v in fields.items() if k not in used and not absent(v)} if searched else {}
        else:
            pri = _PRI.match(text.lstrip())
            level = int(pri.group(1)) % 8 if pri and int(pri.group(1)) <= 191 else None
            class_uid, activity, severity, values, seen = 0, 0, 1 if level is None else _OCSF_SEVERITY[level], {}, []
            time, source = leading_time(text, self.year) if searched or wanted & {"time", "time_source"} else (None, "receipt")
            time = received if time is None else time
            rest = generic(text) if searched else {}
            unmapped |= {"disposition": disposition, "time_source": source} | ({"reason": error} if error else {}) | ({"syslog_severity": str(level)} if level is not None else {})
        have = {(i, v) for _, i, v in seen}
        extra = [("raw_data", i, v) for i, v in salvage(text) if (i, v) not in have] if searched else []
        if locator:
            unmapped["raw_locator"] = locator
        if searched and (told := {k: v for k, v in (receipt or {}).items() if v is not None}):
            unmapped["receipt"] = json.dumps(told, ensure_ascii=False, separators=(",", ":"))
        if extra:
            unmapped["salvaged_count"] = str(len(extra))
        unmapped = {k: str(v) for k, v in ((p[9:], values.pop(p)) for p in [p for p in values if p.startswith("unmapped.")])} | unmapped
        unmapped |= {k: v for k, v in rest.items() if k not in unmapped}
        seen += extra
        ms = f"{max(0, (received or 0) // 1_000_000):012x}"[-12:]
        digest = hashlib.sha256(f"{locator or ''}\0{sha}".encode()).hexdigest()
        uid = f"{ms[:8]}-{ms[8:]}-7{digest[:3]}-8{digest[3:6]}-{digest[6:18]}"
        pack = found[0] if found else None
        observables = [{"name": n, "type_id": i, "value": v} for n, i, v in seen]
        written = None
        if whole or "event_json" in wanted:
            event = {
                "class_uid": class_uid, "category_uid": class_uid // 1000, "activity_id": activity, "type_uid": class_uid * 100 + activity, "severity_id": severity, "time": time,
                "metadata": {"version": VERSION, "product": {"name": pack.product, "vendor_name": pack.vendor} if pack else None, "uid": uid, "log_provider": pack.id if parsed else None, "log_format": pack.log_format if parsed else None, "logged_time": received, "processed_time": self.processed_at},
                "raw_data": text if self.inline_raw or not parsed else None, "raw_data_size": len(raw), "raw_data_hash": {"algorithm_id": 3, "value": sha},
            }
            event = _pruned(event)
            for path, v in values.items():
                at = event
                *parents, leaf = path.split(".")
                for p in parents:
                    at = at.setdefault(p, {})
                at[leaf] = v
            if observables:
                event["observables"] = observables
            if unmapped:
                event["unmapped"] = unmapped
            written = json.dumps(event, ensure_ascii=False, separators=(",", ":"))
        return {
            "event_uid": uid, "text": text, "pack_id": pack.id if pack else None, "vendor": pack.vendor if pack else None, "product": pack.product if pack else None,
            "disposition": disposition, "reason": error, "fields": fields, "class_uid": class_uid, "category_uid": class_uid // 1000, "activity_id": activity,
            "type_uid": class_uid * 100 + activity, "severity_id": severity, "time": time, "time_source": source, "observables": observables, "unmapped": unmapped,
            "raw_size": len(raw), "raw_sha256": sha, "event_json": written,
        }


def _pruned(value):
    return {k: _pruned(v) for k, v in value.items() if v is not None} if isinstance(value, dict) else value


_STRINGS = ("event_uid", "text", "pack_id", "vendor", "product", "disposition", "reason", "time_source", "raw_sha256", "event_json")
_LONGS = ("class_uid", "category_uid", "activity_id", "type_uid", "severity_id", "time", "raw_size")
_TYPES = {
    **dict.fromkeys(_STRINGS, (pa.string(), "string")), **dict.fromkeys(_LONGS, (pa.int64(), "bigint")),
    "fields": (pa.map_(pa.string(), pa.string()), "map<string,string>"), "unmapped": (pa.map_(pa.string(), pa.string()), "map<string,string>"),
    "observables": (pa.list_(pa.struct([("name", pa.string()), ("type_id", pa.int32()), ("value", pa.string())])), "array<struct<name:string,type_id:int,value:string>>"),
}


def normalise(raw: DataFrame, packs: list[Pack], year: int, inline_raw: bool = False, processed_at: int | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One event per record; see ``operators.normalise.normalise``, whose columns these are (without the nested struct).

    ``raw`` needs the column raw (bytes; null counts as an empty record); missing envelope
    columns are null, further columns pass through. With ``columns`` only these columns of the
    event come out, and only what they need is worked out.
    """
    types = {c: t for c, t in _TYPES.items() if columns is None or c in columns}
    if columns is not None and set(columns) - set(_TYPES):
        raise ValueError(f"no columns of an event: {sorted(set(columns) - set(_TYPES))}")
    have = raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast(t).alias(c) for c, t in ENVELOPE.items()], *[c for c in raw.columns if c not in ENVELOPE and c not in _TYPES])
    kept = [c for c in have.columns if c != "raw"]
    schema = ", ".join([f"`{c}` {have.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {t[1]}" for c, t in types.items()])
    wanted = frozenset(columns or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine(packs, year, inline_raw, processed_at)
        at = {c: i for i, c in enumerate(have_columns)}
        for batch in batches:
            column = lambda c: batch.column(at[c])  # noqa: B023, E731
            received = [_ns(x) for x in column("received_at").to_pylist()]
            receipts = batch.select(RECEIPT).to_pylist()
            rows = [engine.event(r or b"", t, loc, wanted, receipt) for r, t, loc, receipt in zip(column("raw").to_pylist(), received, column("locator").to_pylist(), receipts)]
            made = [pa.array([list(r[c].items()) if isinstance(r[c], dict) else r[c] for r in rows], t[0]) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays([*[column(c) for c in kept], *made], names=[*kept, *types])

    have_columns = have.columns
    return have.mapInArrow(run, schema)


def _ns(x: int | None) -> int | None:
    if x is None:
        return None
    size = abs(x)
    return x * 1_000_000_000 if size < 10**11 else x * 1_000_000 if size < 10**14 else x * 1_000 if size < 10**17 else x
