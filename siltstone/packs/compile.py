"""Packs to column expressions: identification, extraction and mapping."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import decode as D
from ..functions.times import parse_time
from ..functions.values import OBSERVABLE_IDS, as_bool, as_float, as_int, let, present
from .spec import Pack

#: A tag behind 15 bytes of stamp and a host, with an optional PRI before them; and the same behind the prefix of collected corpora.
_TAIL = r"[\s\S]{15}\s*\S+\s+([A-Za-z0-9\-_./()]{1,%d})(?:\[\d*\])?:(?=\s|\z)"
_SYSLOG_TAG = r"^\s*(?:<[^>]{0,3}>|(?!<))" + _TAIL % 32
_CORPUS_TAG = r"^\s*\S+\s+\d{10}\s+\d{4}\.\d{2}\.\d{2}\s+\S+\s+" + _TAIL % 128


def detector(text: Column, d: dict) -> Column:
    """AND of the clauses that are present; an empty detector claims nothing."""
    clauses: list[Column] = [text.contains(x) for x in d.get("contains_all") or []]
    if d.get("contains_any"):
        clauses.append(reduce(Column.__or__, [text.contains(x) for x in d["contains_any"]]))
    clauses += [~text.contains(x) for x in d.get("contains_none") or []]
    if d.get("starts_with") is not None:
        clauses.append(text.startswith(d["starts_with"]))
    if d.get("syslog_tag"):
        clauses.append(text.rlike(_SYSLOG_TAG))
    if d.get("loghub_syslog_prefix"):
        clauses.append(text.rlike(_CORPUS_TAG))
    return reduce(Column.__and__, clauses) if clauses else F.lit(False)


def claims(text: Column, pack: Pack) -> Column:
    return F.coalesce(reduce(Column.__or__, [detector(text, d) for d in pack.detect]), F.lit(False))


def identify(text: Column, packs: list[Pack]) -> Column:
    """The id of the first pack, by priority, that claims the text; null if none does."""
    out = F.lit(None).cast("string")
    for pack in reversed(packs):
        out = F.when(claims(text, pack), pack.id).otherwise(out)
    return out


def step_decoder(text: Column, step: dict) -> Column:
    name = step["decoder"]
    if name.startswith("syslog"):
        return D.syslog_decoder(text, {"syslog": "auto"}.get(name, name[7:]))
    if name == "keyvalue":
        return D.keyvalue_decoder(text, step.get("sep", "="), step.get("delim", " "))
    if name == "csv":
        return D.csv_decoder(text, step.get("delim", ","), step.get("headers"))
    if name == "regex":
        return D.regex_decoder(text, step["patterns"])
    return {"cef": D.cef_decoder, "leef": D.leef_decoder, "json": D.json_decoder, "xml": D.xml_decoder}[name](text)


SPEC = "p string, l string, c array<string>, d string, e map<string,string>, f string, a string, o int"


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value)


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def target_type(pack: Pack, spec) -> str:
    """The type of a mapped value: of its literal, cast, time or enum; text otherwise."""
    if not isinstance(spec, dict):
        return _kind(spec)
    if spec.get("format"):
        return "bigint"
    if spec.get("as"):
        return {"int": "bigint", "float": "double", "bool": "boolean", "string": "string"}[spec["as"]]
    if spec.get("enum"):
        kinds = {_kind(v) for v in pack.enums[spec["enum"]].values()} | ({_kind(spec["default"])} if "default" in spec else set())
        return kinds.pop() if len(kinds) == 1 else "string"
    return "string"


def mapping_table(packs: list[Pack]) -> Column:
    """All mappings as one literal: pack id to the list of its targets. The plan does not grow with the packs."""
    table = {}
    for pack in packs:
        rows = []
        for path, spec in sorted(pack.map.items(), key=lambda kv: kv[0].count(".")):
            if isinstance(spec, dict):
                names = spec["from"] if isinstance(spec["from"], list) else [spec["from"]]
                enum = pack.enums[spec["enum"]] if spec.get("enum") else None
                rows.append({
                    "p": path, "l": None, "c": names, "d": _text(spec.get("default")), "e": {k: _text(v) for k, v in enum.items()} if enum is not None else None,
                    "f": spec.get("format") or "", "a": spec.get("as") or "", "o": OBSERVABLE_IDS[spec["observable"]] if spec.get("observable") else 0,
                })
            else:
                rows.append({"p": path, "l": _text(spec), "c": [], "d": None, "e": None, "f": "", "a": "", "o": 0})
        table[pack.id] = rows
    return F.from_json(F.lit(json.dumps(table)), f"map<string,array<struct<{', '.join(c.replace(' ', ':', 1) for c in SPEC.split(', '))}>>>")


def mapped_values(fields: Column, specs: Column, packs: list[Pack], year: int) -> Column:
    """``array<struct<p, o, w, v>>``: path, observable type, winning field and value (text) of every target."""
    formats = sorted({s["format"] for p in packs for s in p.map.values() if isinstance(s, dict) and s.get("format")})

    def typed(s: Column, v: Column) -> Column:
        enum = F.coalesce(F.try_element_at(s["e"], v), F.try_element_at(s["e"], F.lower(v)), F.try_element_at(s["e"], as_int(v).cast("string")))
        out = F.when(s["e"].isNotNull(), enum)
        for fmt in formats:
            out = out.when(s["f"] == fmt, parse_time(v, fmt, year).cast("string"))
        for name, cast in (("int", as_int), ("float", as_float), ("bool", as_bool)):
            out = out.when(s["a"] == name, cast(v).cast("string"))
        return F.coalesce(out.otherwise(v), s["d"])

    def one(s: Column) -> Column:
        winner = F.get(F.filter(s["c"], lambda n: present(F.try_element_at(fields, n)).isNotNull()), F.lit(0))

        def valued(w: Column) -> Column:
            return F.struct(s["p"].alias("p"), s["o"].alias("o"), w.alias("w"), F.coalesce(s["l"], let(F.try_element_at(fields, w), lambda v: typed(s, v))).alias("v"))

        return let(winner, valued)

    return F.transform(specs, one)


def step_key(step: dict) -> str:
    """Steps with the same key decode alike, whatever pack they are of."""
    return json.dumps({k: v for k, v in step.items() if k != "optional"}, sort_keys=True)
