"""Decoders: a text column to ``struct<fields map<string,string>, body string, error string>``.

A decoder that does not apply has a null ``fields`` and an ``error``; one that ends its chain
has a null ``body``. All but JSON and XML are built from generated JVM code.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import let, unescape

MAP = "map<string,string>"
_PAIR, _SPLIT = "\x01", "\x02"


def result(ok: Column, fields: Column, body: Column | None, error: str) -> Column:
    """The decoder's struct."""
    return F.struct(
        F.when(ok, fields).alias("fields"),
        F.when(ok, F.lit(None).cast("string") if body is None else body).alias("body"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(error)).alias("error"),
    )


def first_wins(keys: Column, values: Column) -> Column:
    """A map of parallel arrays in which the first of equal keys counts; null keys are dropped."""

    def build(zipped: Column) -> Column:
        return let(
            F.transform(zipped, lambda e: e["k"]),
            lambda ks: F.map_from_entries(F.filter(zipped, lambda e, i: e["k"].isNotNull() & (F.array_position(ks, e["k"]) == i + 1))),
        )

    return let(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), build)


def last_wins(keys: Column, values: Column) -> Column:
    return first_wins(F.reverse(keys), F.reverse(values))


def merge_keep_first(one: Column, two: Column) -> Column:
    """Entries of both maps, those of ``one`` where both have the key."""
    return let(one, lambda first: F.map_concat(first, F.map_filter(two, lambda k, v: ~F.map_contains_key(first, k))))


def without_empty(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (v != ""))


# --- regular expressions ------------------------------------------------------------------


def java_pattern(pattern: str) -> tuple[str, list[str]]:
    """A pattern with ``(?P<name>…)`` groups for the JVM, and the names of its groups by number ('' if unnamed).

    Classes match Unicode and ``.`` all but LF, as in the dialect that packs are written in.
    """
    names: list[str] = []
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "]":
                out.append("[\\]")
                i += 2
                continue
        elif c == "(":
            named = re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(pattern, i)
            if named:
                names.append(named.group(1))
                out.append("(")
                i = named.end()
                continue
            if pattern[i + 1 : i + 2] != "?":
                names.append("")
        out.append(c)
        i += 1
    return "(?dU)" + "".join(out), names


def regex_decoder(text: Column, patterns: list[str]) -> Column:
    """The named groups of the first pattern found; group ``body`` narrows the body, else the whole line goes on.

    With several patterns ``regex.matched`` is the number of the one that matched. A pattern is
    run once per line: its groups are rewritten to a delimited text that is split to a map.
    """
    return let(F.regexp_replace(text, r"[\r\n]+\z", ""), lambda line: _regex(line, patterns))


def _regex(line: Column, patterns: list[str]) -> Column:
    out = F
    none = "regex: no pattern matched"
    for index, pattern in enumerate(patterns):
        java, names = java_pattern(pattern)
        whole = rf"(?s)\A.*?(?-s:{java})(?s:.*)\z"
        groups = [(n, k + 1) for k, n in enumerate(names) if n]
        pairs = [f"{n}{_SPLIT}${k}" for n, k in groups] + ([f"regex.matched{_SPLIT}{index}"] if len(patterns) > 1 else [])
        hit = line.rlike(java)
        got = F.str_to_map(F.regexp_replace(line, whole, _PAIR.join(pairs)), F.lit(_PAIR), F.lit(_SPLIT)) if pairs else F.create_map().cast(MAP)
        at = next((k for n, k in groups if n == "body"), None)
        body = F.regexp_extract(line, java, at) if at else line
        out = out.when(hit, F.struct(without_empty(got).alias("fields"), body.alias("body"), F.lit(None).cast("string").alias("error")))
    nothing = F.struct(F.lit(None).cast(MAP).alias("fields"), F.lit(None).cast("string").alias("body"), F.lit(none).alias("error"))
    return out.otherwise(nothing)


# --- syslog -------------------------------------------------------------------------------

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_PRI = r"^<(\d{1,3})>"
_STAMP = rf"^({_MONTH} [ \d]\d (?:\d\d:\d\d:\d\d|\d{{4}} \d\d:\d\d:\d\d)) ?"
_HOST = r"^([A-Za-z0-9._-]{1,255})(?: |\z)"
_TAG = r"^(?=[^:]{1,40}:)([A-Za-z0-9._/-]+)(?:\[(\d*)\])?: ?"
_SD = r'^(?:\[(?:[^\]"\\]|\\(?!")|"(?:[^"\\]|\\.)*+")*\])+'


def syslog_decoder(text: Column, dialect: str = "auto") -> Column:
    """RFC 3164 and 5424 headers. ``dialect`` auto, rfc3164 or rfc5424; a forced one wants a PRI."""
    error = "syslog: empty, without <PRI> or with unterminated structured data"
    nothing = F.struct(F.lit(None).cast(MAP).alias("fields"), F.lit(None).cast("string").alias("body"), F.lit(error).alias("error"))

    def headed(head: Column) -> Column:
        number, rest = head["number"], head["rest"]
        numbers = {
            "syslog.priority": number.cast("string"), "syslog.facility": F.call_function("div", number, F.lit(8)).cast("string"), "syslog.severity": (number % 8).cast("string"),
        }
        is_5424 = {"auto": rest.rlike(r"^\d{1,2} "), "rfc3164": F.lit(False), "rfc5424": F.lit(True)}[dialect]
        ok = (head["line"] != "") & (F.lit(True) if dialect == "auto" else number.isNotNull())
        return F.when(ok & is_5424, _rfc5424(rest, numbers, nothing)).when(ok, _rfc3164(rest, numbers)).otherwise(nothing)

    line = F.regexp_replace(text, r"[\r\n\x00]+\z", "")
    number = lambda x: F.when(F.regexp_extract(x, _PRI, 1).try_cast("int").between(0, 191), F.regexp_extract(x, _PRI, 1).try_cast("int"))
    with_number = let(line, lambda x: F.struct(x.alias("line"), number(x).alias("number")))
    return let(
        with_number,
        lambda h: let(F.struct(h["line"].alias("line"), h["number"].alias("number"), F.when(h["number"].isNotNull(), F.regexp_replace(h["line"], _PRI, "")).otherwise(h["line"]).alias("rest")), headed),
    )


def _named(pairs: dict[str, Column]) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values())), lambda k, v: v.isNotNull())


def _done(fields: Column, body: Column) -> Column:
    return F.struct(fields.alias("fields"), body.alias("body"), F.lit(None).cast("string").alias("error"))


def _rfc3164(rest: Column, numbers: dict[str, Column]) -> Column:
    def after(at: Column) -> Column:
        stamp = F.nullif(F.regexp_extract(rest, _STAMP, 1), F.lit(""))
        host = F.when(stamp.isNotNull(), F.nullif(F.regexp_extract(at, _HOST, 1), F.lit("")))
        return let(
            F.when(stamp.isNotNull(), F.regexp_replace(at, _HOST, "")).otherwise(at),
            lambda body: let(
                F.nullif(F.regexp_extract(body, _TAG, 1), F.lit("")),
                lambda tag: let(
                    F.when(tag.isNotNull(), F.regexp_replace(body, _TAG, "")).otherwise(body),
                    lambda left: _done(
                        _named(numbers | {
                            "syslog.timestamp": stamp, "syslog.hostname": host, "syslog.appname": tag,
                            "syslog.procid": F.when(tag.isNotNull() & body.rlike(r"^[A-Za-z0-9._/-]+\["), F.regexp_extract(body, _TAG, 2)), "syslog.body": left,
                        }),
                        left,
                    ),
                ),
            ),
        )

    return let(F.regexp_replace(rest, _STAMP, ""), after)


def _rfc5424(rest: Column, numbers: dict[str, Column], nothing: Column) -> Column:
    head = r"^(\S*) ?(\S*) ?(\S*) ?(\S*) ?(\S*) ?(\S*) ?"
    token = lambda i: F.nullif(F.nullif(F.regexp_extract(rest, head, i), F.lit("")), F.lit("-"))
    names = ("version", "timestamp", "hostname", "appname", "procid", "msgid")
    block = r'\[((?:[^\]"\\]|\\(?!")|"(?:[^"\\]|\\.)*+")*)\]'
    param = r'\s([^\s="]+)="((?:[^"\\]|\\.)*)"'
    block_id = lambda b: F.concat(F.lit("syslog.sd."), F.regexp_extract(b, r"^(\S*)", 1))

    def with_sd(after: Column, sd: Column) -> Column:
        left = (
            F.when(after.startswith("-"), F.regexp_replace(after, r"^- ?", ""))
            .when(sd != "", F.regexp_replace(F.substr(after, F.length(sd) + 1), "^ ", ""))
            .otherwise(after)
        )
        body = F.regexp_replace(left, "^\ufeff", "")
        blocks = F.regexp_extract_all(sd, F.lit(block), 1)
        keys = F.flatten(F.transform(blocks, lambda b: F.concat(F.array(block_id(b)), F.transform(F.regexp_extract_all(b, F.lit(param), 1), lambda k: F.concat(block_id(b), F.lit("."), k)))))
        values = F.flatten(F.transform(blocks, lambda b: F.concat(F.array(F.regexp_extract(b, r"^(\S*)", 1)), F.regexp_extract_all(b, F.lit(param), 2))))
        named = _named(numbers | {f"syslog.{n}": token(i + 1) for i, n in enumerate(names)} | {"syslog.body": body})
        return F.when(after.startswith("[") & (sd == ""), nothing).otherwise(_done(merge_keep_first(named, last_wins(keys, values)), body))

    return let(F.regexp_replace(rest, head, ""), lambda after: let(F.regexp_extract(after, _SD, 0), lambda sd: with_sd(after, sd)))


# --- key=value, delimited -----------------------------------------------------------------


def keyvalue_decoder(text: Column, sep: str = "=", delim: str = " ") -> Column:
    """Pairs anywhere in the text; the last of equal keys counts. Quoted values may hold escapes."""
    s, d = re.escape(sep), re.escape(delim)
    line = F.regexp_replace(text, r"^\s+|\s+\z", "")
    pattern = rf'([^{d}{s}]*){s}("(?:[^"\\]|\\.)*+"|"[\s\S]*|[^{d}]*)'

    def built(x: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(x, F.lit(pattern), 1), lambda x: F.trim(x))
        values = F.transform(
            F.regexp_extract_all(x, F.lit(pattern), 2),
            lambda v: F.when(v.rlike(r'^"(?:[^"\\]|\\.)*"\z'), unescape(F.substr(v, F.lit(2), F.length(v) - 2))).when(v.startswith('"'), F.substr(v, F.lit(2))).otherwise(v),
        )
        return let(F.map_filter(last_wins(keys, values), lambda k, v: k != ""), lambda m: result(F.size(m) > 0, m, None, f"keyvalue: no `{sep}` pairs found"))

    return let(line, built)


def csv_fields(text: Column, delim: str = ",") -> Column:
    """The fields of one delimited record; text after a closing quote that is no delimiter ends it."""
    d = re.escape(delim)
    line = F.regexp_replace(text, r"[\r\n]+\z", "")
    pattern = rf'\G{d}("(?:[^"]|"")*+"|"[\s\S]*|[^{d}]*)'
    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(delim), line), F.lit(pattern), 1),
        lambda v: F.when(v.rlike(r'^"(?:[^"]|"")*+"\z'), F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).when(v.startswith('"'), F.substr(v, F.lit(2))).otherwise(v),
    )
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, d, -1))


def csv_decoder(text: Column, delim: str = ",", headers: list[str] | None = None) -> Column:
    """``col.N`` of every field, the header names of those that have one, and ``col.count``."""
    names = F.array(*[F.lit(h) for h in headers]) if headers else F.array().cast("array<string>")

    def built(columns: Column) -> Column:
        n = F.size(columns)
        positions = F.transform(columns, lambda v, i: F.concat(F.lit("col."), i.cast("string")))
        named = F.transform(F.slice(names, F.lit(1), n), lambda h: F.nullif(h, F.lit("")))
        keys = F.concat(named, positions, F.array(F.lit("col.count")))
        values = F.concat(F.slice(columns, F.lit(1), F.size(named)), columns, F.array(n.cast("string")))
        return result(F.coalesce(~((n == 1) & (columns[0] == "")), F.lit(False)), first_wins(keys, values), None, "csv: empty")

    return let(csv_fields(text, delim), built)


# --- CEF, LEEF ----------------------------------------------------------------------------

_CEF_FIELD = r"((?:[^|\\]|\\.)*)\|"
_CEF = r"(?s)CEF:" + _CEF_FIELD * 7 + r"(.*)\z"
_CEF_NAMES = ("cef.version", "cef.device_vendor", "cef.device_product", "cef.device_version", "cef.signature_id", "cef.name", "cef.severity")
_CEF_EXT = r"(?s)(?:^| )((?:[^ =\\]|\\.)+)=((?:(?! (?:[^ =\\]|\\.)+=)(?:\\.|[^\\]))*)"


def cef_decoder(text: Column) -> Column:
    """Header fields as ``cef.*`` and the extension's pairs; a value runs to the next `` key=``."""

    def built(line: Column) -> Column:
        header = F.array(*[unescape(F.regexp_extract(line, _CEF, k + 1), named=False) for k in range(len(_CEF_NAMES))])
        ext = F.ltrim(F.regexp_extract(line, _CEF, 8))
        keys = F.transform(F.regexp_extract_all(ext, F.lit(_CEF_EXT), 1), lambda x: F.trim(x))
        values = F.transform(F.regexp_extract_all(ext, F.lit(_CEF_EXT), 2), lambda v: unescape(F.rtrim(v)))
        named = F.map_from_arrays(F.array(*[F.lit(n) for n in _CEF_NAMES]), header)
        return result(F.coalesce(line.rlike(_CEF), F.lit(False)), merge_keep_first(named, last_wins(keys, values)), None, "cef: no `CEF:` marker or truncated header")

    return let(F.regexp_replace(text, r"[\r\n]+\z", ""), built)


def leef_decoder(text: Column) -> Column:
    """LEEF 1.0 (tab extension) and 2.0 (own delimiter: one character, ``0x09`` or empty for tab)."""
    return let(F.trim(F.regexp_replace(text, r"[\r\n]+\z", "")), _leef)


def _leef(line: Column) -> Column:
    v2 = r"(?s)^LEEF:(2[^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(?:(.|0x09|)\|)?(.*)\z"
    v1 = r"(?s)^LEEF:([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^\t|]*)(?:[\t|](.*))?\z"
    is2 = line.rlike(v2)
    get = lambda i: F.when(is2, F.regexp_extract(line, v2, i)).otherwise(F.regexp_extract(line, v1, i))
    ext = F.when(is2, F.regexp_extract(line, v2, 7)).otherwise(F.regexp_extract(line, v1, 6))
    mark = F.when(is2, F.regexp_extract(line, v2, 6)).otherwise(F.lit(""))
    delim = F.when(mark.isin("", "0x09"), F.lit("\t")).otherwise(mark)
    parts = F.filter(F.transform(F.split(F.replace(ext, delim, F.lit(_PAIR)), _PAIR), lambda x: F.trim(x)), lambda p: p.rlike(r"^(?:[^=\\]|\\.)+="))
    keys = F.transform(parts, lambda p: F.trim(F.regexp_extract(p, r"(?s)^((?:[^=\\]|\\.)+)=(.*)\z", 1)))
    values = F.transform(parts, lambda p: unescape(F.trim(F.regexp_extract(p, r"(?s)^((?:[^=\\]|\\.)+)=(.*)\z", 2))))
    names = ("leef.version", "leef.vendor", "leef.product", "leef.product_version", "leef.event_id")
    named = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[get(i + 1) for i in range(5)]))
    return result(F.coalesce(is2 | line.rlike(v1), F.lit(False)), merge_keep_first(named, last_wins(keys, values)), None, "leef: no `LEEF:` prefix or truncated header")


# --- JSON, XML ----------------------------------------------------------------------------


def _flat_json(text: str | None) -> dict[str, str] | None:
    import json

    try:
        top = json.loads(text or "", parse_int=str, parse_float=lambda x: repr(float(x)))
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, (dict, list)):
        return None
    out: dict[str, str] = {}
    stack = [("", top)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            out[f"{path}.len" if path else "len"] = str(len(value))
            stack.extend((f"{path}.{i}" if path else str(i), v) for i, v in reversed(list(enumerate(value))))
        elif value is not None:
            out[path] = ("true" if value else "false") if isinstance(value, bool) else str(value)
    return out


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _entities(text: str) -> str:
    for name, char in _ENTITIES:
        text = text.replace(name, char)
    return text


def _flat_xml(text: str | None) -> dict[str, str] | None:
    """A tolerant scan: comments, instructions and CDATA are skipped; repeated siblings get ``.N``."""
    source = (text or "").strip()
    if not source.startswith("<"):
        return None
    out: dict[str, str] = {}
    stack: list[tuple[str, dict[str, int], list[str]]] = [("", {}, [])]
    found = False
    for m in re.finditer(r"(?s)<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*>|<(/?)([^\s/>]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|([^<]+)", source):
        closing, name, attributes, alone, words = m.groups()
        if words is not None:
            stack[-1][2].append(words)
        elif name is None:
            continue
        elif closing:
            if len(stack) > 1:
                path, _, parts = stack.pop()
                value = _entities("".join(parts).strip())
                if value:
                    out.setdefault(path, value)
        else:
            found = True
            parent, seen, _ = stack[-1]
            n = seen.get(name, 0)
            seen[name] = n + 1
            path = (f"{parent}.{name}" if parent else name) + (f".{n}" if n else "")
            for key, double, single in re.findall(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attributes or ""):
                out[f"{path}.@{key}"] = _entities(double or single)
            if not alone:
                stack.append((path, {}, []))
    while len(stack) > 1:
        path, _, parts = stack.pop()
        value = _entities("".join(parts).strip())
        if value:
            out.setdefault(path, value)
    return out if found else None


def _vectorised(flatten):
    @F.pandas_udf(MAP)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([flatten(t) for t in texts], dtype=object)

    return run


def let_udf(fields: Column, error: str) -> Column:
    """The struct of a map that is null where the decoder does not apply."""
    return result(fields.isNotNull(), fields, None, error)


def json_decoder(text: Column) -> Column:
    """An object or array flattened to dotted keys, ``k.N`` and ``k.len``; nulls have no key."""
    return let_udf(_vectorised(_flat_json)(text), "json: no object or array")


def xml_decoder(text: Column) -> Column:
    """Elements as dotted paths, attributes as ``path.@name``."""
    return let_udf(_vectorised(_flat_xml)(text), "xml: no element")


# --- lines that no pack claims --------------------------------------------------------------

MAX_FIELDS, MAX_KEY, MAX_VALUE = 64, 64, 512


def generic_fields(text: Column) -> Column:
    """``key=value`` pairs of any line, or the scalars of a JSON object: at most 64, the first of equal keys.

    Values beyond 512 bytes are cut at a character; keys beyond 64 are dropped.
    """
    pattern = r'([A-Za-z0-9_.-]+)=(?:"([^"]*)"|("[\s\S]*)|(\S*))'
    keys = F.regexp_extract_all(text, F.lit(pattern), 1)
    both = lambda a, b: F.concat(a, b)
    values = F.zip_with(
        F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 2), F.regexp_extract_all(text, F.lit(pattern), 3), both),
        F.regexp_extract_all(text, F.lit(pattern), 4), both,
    )
    as_json = F.from_json(F.trim(text), MAP)
    is_json = F.ltrim(text).startswith("{") & F.try_parse_json(F.trim(text)).isNotNull()
    json_keys = F.map_keys(F.map_filter(as_json, lambda k, v: v.isNotNull() & ~v.startswith("{") & ~v.startswith("[")))
    json_values = F.transform(json_keys, lambda k: F.try_element_at(as_json, k))
    cut = lambda v: F.when(F.octet_length(v) <= MAX_VALUE, v).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(v.cast("binary"), 1, MAX_VALUE).cast("string")), "\ufffd+$", ""))

    def kept(zipped: Column) -> Column:
        entries = F.filter(zipped, lambda e: (e["k"] != "") & (e["v"] != "") & (F.octet_length(e["k"]) <= MAX_KEY))
        named = first_wins(F.transform(entries, lambda e: e["k"]), F.transform(entries, lambda e: cut(e["v"])))
        return let(F.map_entries(named), lambda es: F.map_from_entries(F.slice(es, 1, MAX_FIELDS)))

    zipped = F.zip_with(F.when(is_json, json_keys).otherwise(keys), F.when(is_json, json_values).otherwise(values), lambda k, v: F.struct(F.trim(k).alias("k"), F.trim(v).alias("v")))
    return let(zipped, kept)


def generic_severity(text: Column) -> Column:
    """The syslog severity of a leading PRI, or null."""
    number = F.regexp_extract(F.ltrim(text), _PRI, 1).try_cast("int")
    return F.when(number.between(0, 191), number % 8)
