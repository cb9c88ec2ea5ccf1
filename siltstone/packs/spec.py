"""Load and validate packs."""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass, field

import yaml

from ..decode import java_pattern
from ..functions.times import EPOCHS, FORMATS
from ..functions.values import OBSERVABLE_IDS
from .layouts import expression

DECODERS = ("syslog", "syslog_rfc3164", "syslog_rfc5424", "keyvalue", "csv", "cef", "leef", "json", "xml", "regex")
#: Targets that the engine writes itself.
RESERVED = ("category_uid", "type_uid", "metadata", "raw_data", "raw_data_size", "raw_data_hash", "attestation_list", "observables")
DETECT_KEYS = {"contains_all", "contains_any", "contains_none", "starts_with", "syslog_tag", "loghub_syslog_prefix"}
FIELD_KEYS = {"from", "default", "enum", "format", "as", "observable"}
LIBRARY = os.path.join(os.path.dirname(__file__), "library")


class PackError(ValueError):
    """A pack that can not be used, with the reason."""


@dataclass
class Pack:
    id: str
    vendor: str
    product: str
    priority: int
    log_format: str
    detect: list[dict]
    extract: list[dict]
    map: dict
    enums: dict
    fixtures: list[dict] = field(default_factory=list)


def _check(ok: bool, pack: str, what: str) -> None:
    if not ok:
        raise PackError(f"{pack}: {what}")


def _written_out(step: dict, pack: str) -> dict:
    """A step of line layouts as the step of expressions that it stands for."""
    if step.get("decoder") != "layout":
        return step
    _check(set(step) <= {"decoder", "optional", "lines", "kinds"} and bool(step.get("lines")), pack, "unknown step members of layout, or no lines")
    try:
        patterns = [expression(line, step.get("kinds")) for line in step["lines"]]
    except (ValueError, TypeError) as error:
        raise PackError(f"{pack}: {error}") from error
    return {"decoder": "regex", "patterns": patterns} | ({"optional": True} if step.get("optional") else {})


def parse_pack(text: str) -> Pack:
    """A pack from its YAML, validated: unknown members, decoders, enums and targets are errors."""
    data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise PackError("no mapping")
    identity = data.get("identity") or {}
    name = str(identity.get("id") or "")
    _check(bool(name), "?", "identity.id is empty")
    unknown = set(data) - {"identity", "extract", "map", "enums", "fixtures", "provenance"}
    _check(not unknown, name, f"unknown members {sorted(unknown)}")
    for key in ("vendor", "product"):
        _check(bool(identity.get(key)), name, f"identity.{key} is empty")
    detect, extract, mapping, enums = identity.get("detect") or [], data.get("extract") or [], data.get("map") or {}, data.get("enums") or {}
    _check(bool(detect), name, "identity.detect is empty")
    _check(bool(extract), name, "extract is empty")
    for d in detect:
        _check(set(d) <= DETECT_KEYS, name, f"unknown detector members {sorted(set(d) - DETECT_KEYS)}")
    extract = [_written_out(step, name) for step in extract]
    for step in extract:
        _check(step.get("decoder") in DECODERS, name, f"unknown decoder {step.get('decoder')}")
        _check(set(step) <= {"decoder", "optional", "patterns", "delim", "sep", "headers"}, name, f"unknown step members of {step.get('decoder')}")
        for pattern in step.get("patterns") or []:
            try:
                re.compile(java_pattern(pattern)[0].replace("(?dU)", ""))
            except re.error as error:
                raise PackError(f"{name}: pattern {pattern!r}: {error}") from error
    for target in ("class_uid", "activity_id"):
        _check(target in mapping, name, f"map.{target} is missing")
    for target, spec in mapping.items():
        _check(target.split(".")[0] not in RESERVED, name, f"{target} is reserved")
        if isinstance(spec, dict):
            _check("from" in spec, name, f"{target}: no `from`")
            _check(set(spec) <= FIELD_KEYS, name, f"{target}: unknown members {sorted(set(spec) - FIELD_KEYS)}")
            _check(spec.get("enum") is None or spec["enum"] in enums, name, f"{target}: unknown enum {spec.get('enum')}")
            _check(spec.get("format") is None or spec["format"] in EPOCHS or spec["format"] in FORMATS, name, f"{target}: unknown format {spec.get('format')}")
            _check(spec.get("observable") is None or spec["observable"] in OBSERVABLE_IDS, name, f"{target}: unknown observable {spec.get('observable')}")
            _check(not (spec.get("format") and (spec.get("as") or spec.get("enum"))), name, f"{target}: format excludes as and enum")
            _check(spec.get("as") in (None, "int", "float", "bool", "string"), name, f"{target}: unknown type {spec.get('as')}")
    for target in mapping:
        parts = target.split(".")
        for k in range(1, len(parts)):
            _check(".".join(parts[:k]) not in mapping, name, f"{target} lies below a mapped value")
    return Pack(
        name, identity["vendor"], identity["product"], int(identity.get("priority", 100)), str(identity.get("log_format", "")), detect, extract, mapping,
        {k: {str(a): b for a, b in v.items()} for k, v in enums.items()}, data.get("fixtures") or [],
    )


def load_library(folder: str = LIBRARY) -> tuple[list[Pack], dict[str, str]]:
    """Packs of a folder by priority (ties by file name), and the errors of files that can not be used."""
    packs, errors = [], {}
    for path in sorted([*glob.glob(f"{folder}/*.yaml"), *glob.glob(f"{folder}/*.yml")]):
        try:
            with open(path, encoding="utf-8") as f:
                packs.append(parse_pack(f.read()))
        except (PackError, yaml.YAMLError, OSError, TypeError, AttributeError) as error:
            errors[path] = str(error)
    return sorted(packs, key=lambda p: p.priority), errors
