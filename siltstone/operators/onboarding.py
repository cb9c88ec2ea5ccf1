"""Unknown sources: sampling, profiling, drafting, checking and approving of candidate packs."""

from __future__ import annotations

import json
import os
import re
import subprocess

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import fnv1a
from .clustering import SPLIT, cluster
from .fused import Engine

# --- sampling, profiling --------------------------------------------------------------------------


def _words(line: str) -> frozenset[str]:
    return frozenset(t for t in re.split(r"[\s|,;=:]+", line) if t)


def diverse_indices(samples: list[str], k: int) -> list[int]:
    """The shortest sample, then always the one farthest (Jaccard) from those chosen; ties by position."""
    if not samples or k <= 0:
        return []
    sets = [_words(s) for s in samples]
    far = lambda a, b: 1 - len(a & b) / len(a | b) if a | b else 0.0
    chosen = [min(range(len(samples)), key=lambda i: (len(samples[i]), i))]
    while len(chosen) < min(k, len(samples)):
        left = [i for i in range(len(samples)) if i not in chosen]
        chosen.append(max(left, key=lambda i: (min(far(sets[i], sets[j]) for j in chosen), -i)))
    return chosen


#: Product signatures (all of the lower-case literals) and the confidence they give.
SIGNATURES = [
    (("%asa-",), "Cisco", "ASA", 0.99),
    (("devname=", "srcip=", "dstip="), "Fortinet", "FortiGate", 0.97),
    (("kernel:", "src=", "dst=", "proto="), "Linux", "netfilter/iptables", 0.96),
    (('"event_type"', '"flow_id"'), "OISF", "Suricata EVE", 0.98),
    (("[**]", "[classification:"), "Snort", "NIDS", 0.97),
    (("filterlog:",), "pfSense", "filterlog", 0.98),
    (("sshd[",), "OpenBSD", "OpenSSH", 0.97),
    (("#fields", "id.orig_h", "id.resp_h"), "Zeek", "Connection Log", 0.98),
    (("orig=", "action=", "xlatesrc="), "Check Point", "Firewall", 0.92),
]
#: Markers of source families with their weights, and the event class of each (None: no class suggested).
FAMILIES = {
    "network-firewall": (4001, {"firewall": 3.0, "iptables": 4.0, "filterlog": 4.0, "deny": 1.8, "drop": 1.8, "accept": 1.2, "action": 1.1, "srcip": 1.5, "dstip": 1.5, "proto": 1.0}),
    "intrusion-detection": (2004, {"suricata": 5.0, "snort": 5.0, "signature_id": 3.0, "event_type": 2.0, "classification": 2.5, "alert": 1.8, "sid": 1.5, "intrusion": 2.5, "priority": 1.0}),
    "web-or-proxy": (4002, {"http": 2.3, "https": 1.2, "request": 1.5, "uri": 1.8, "url": 1.8, "user_agent": 2.0, "status": 1.0, "proxy": 3.0, "squid": 5.0, "connect": 1.1}),
    "identity-or-authentication": (3002, {"sshd": 5.0, "authentication": 3.0, "login": 2.0, "logon": 2.0, "logout": 2.0, "password": 2.0, "account": 1.3, "username": 1.3, "failed": 0.8}),
    "email": (4009, {"sendmail": 5.0, "postfix": 5.0, "smtp": 3.0, "message-id": 2.5, "recipient": 1.5, "relay": 1.2}),
    "operating-system-or-audit": (1008, {"kernel": 2.2, "systemd": 3.0, "auditd": 5.0, "eventid": 2.0, "process": 1.0, "pid": 1.0, "service": 0.8, "cbs": 3.0}),
    "cloud-or-container": (None, {"kubernetes": 5.0, "container": 2.0, "docker": 4.0, "pod": 2.0, "namespace": 1.5, "aws": 3.0, "azure": 3.0, "gcp": 3.0, "cloud": 1.8}),
    "database": (None, {"postgres": 5.0, "mysql": 5.0, "mongodb": 5.0, "database": 2.5, "query": 1.7, "sql": 2.0, "transaction": 1.2}),
    "endpoint-security": (2004, {"malware": 4.0, "antivirus": 4.0, "edr": 4.0, "quarantine": 3.0, "threat": 2.0, "process_hash": 2.5, "detection": 1.5}),
}
#: Targets that drafts may map to.
KNOWN_PATHS = ("class_uid", "activity_id", "severity_id", "message", "src_endpoint.ip", "src_endpoint.port", "dst_endpoint.ip", "dst_endpoint.port", "connection_info.protocol_name", "device.hostname", "actor.user.name", "url.url_string")
#: Which first members of these targets each class has; every class has the first three targets.
CLASS_ROOTS = {
    4001: ("src_endpoint", "dst_endpoint", "connection_info", "device", "actor", "url", "message"),
    4002: ("src_endpoint", "dst_endpoint", "connection_info", "device", "actor", "message"),
    3002: ("src_endpoint", "dst_endpoint", "device", "actor", "message"),
    4009: ("src_endpoint", "dst_endpoint", "device", "actor", "message"),
    1008: ("src_endpoint", "dst_endpoint", "device", "actor", "message"),
    2004: ("device", "actor", "message"),
}
#: Confidences from which a draft names a product, and takes the class of a family.
NAME_FROM, CLASS_FROM = 0.90, 0.60
#: The literal of a draft for which no detector was found, and how many samples are compared in pairs.
PLACEHOLDER, PAIRED = "REPLACE-WITH-A-LITERAL-UNIQUE-TO-THIS-SOURCE", 8
#: Names taken of at most so many samples, at most so many, and of positions.
NAMED_SAMPLES, MOST_NAMES, MOST_POSITIONS = 5, 60, 40


def wire_format(samples: list[str]) -> tuple[str, float]:
    """The format that at least half of the samples have, and its confidence."""
    n = len(samples) or 1
    share = lambda f: sum(map(bool, map(f, samples))) / n
    syslog = share(lambda s: re.match(r"<\d{1,3}>|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d", s))
    checks = [
        ("cef", share(lambda s: "CEF:" in s), 1.0), ("leef", share(lambda s: "LEEF:" in s), 1.0), ("json", share(lambda s: s.lstrip()[:1] in "{[" and s.strip()), 1.0),
        ("xml", share(lambda s: re.match(r"\s*<[A-Za-z].*</", s)), 0.9), ("keyvalue", share(lambda s: len(re.findall(r"[\w.-]+=", s)) >= 2), 0.9),
    ]
    body, confidence = next(((name, x * w) for name, x, w in checks if x >= 0.5), ("delimited", 0.78) if infer_delimiter(samples) else ("unstructured", 0.35))
    if syslog >= 0.5 and body not in ("cef", "leef"):
        return f"syslog-{body}", max(min(confidence, syslog), 0.55)
    return body, confidence


def infer_delimiter(samples: list[str]) -> str | None:
    """A delimiter that every line has at least twice, in counts that differ by at most one."""
    for d in ("|", "\t", ";", ","):
        counts = [s.count(d) for s in samples[:20]]
        if counts and min(counts) >= 2 and max(counts) - min(counts) <= 1:
            return d
    return None


def infer_decoders(samples: list[str]) -> list[dict]:
    first, chain = samples[0] if samples else "", []
    if re.match(r"<\d{1,3}>|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d", first):
        chain.append({"decoder": "syslog"})
    kind = wire_format(samples)[0].removeprefix("syslog-")
    delim = infer_delimiter(samples)
    chain.append({"decoder": kind} if kind in ("cef", "leef", "json", "xml", "keyvalue") else {"decoder": "csv", "delim": delim} if delim else {"decoder": "keyvalue"})
    return chain


def field_names(samples: list[str]) -> list[str]:
    """Names that the first samples show: keys of pairs and members of objects in order, else positions of a delimited line."""
    names: dict[str, None] = {}
    for sample in samples[:NAMED_SAMPLES]:
        for token in sample.split():
            key, eq, _ = token.partition("=")
            if eq and re.fullmatch(r"[A-Za-z0-9_.]+", key):
                names[key] = None
        if sample.lstrip().startswith("{"):
            try:
                members = json.loads(sample)
            except (ValueError, RecursionError):
                continue
            names |= dict.fromkeys(members if isinstance(members, dict) else ())
    if not names and samples:
        columns = samples[0].count(",") + 1
        names = {f"col.{i}": None for i in range(min(columns, MOST_POSITIONS))} if columns >= 3 else {}
    return list(names)[:MOST_NAMES]


def family_scores(samples: list[str]) -> list[tuple[float, str]]:
    """Score and name of every family, best first, ties by name: the weights of the markers that occur among words, names or, with punctuation, anywhere."""
    text = "\n".join(samples).lower()
    words = set(re.findall(r"[a-z0-9_.-]+", text)) | {n.lower() for n in field_names(samples)}
    occurs = lambda m: m in words or not m.isalnum() and m in text
    scores = [(sum(w for m, w in markers.items() if occurs(m)), name) for name, (_, markers) in FAMILIES.items()]
    return sorted(scores, key=lambda x: (-x[0], x[1]))


def family(samples: list[str]) -> tuple[str, int | None, float]:
    """The source family, its class and the confidence; unknown below a score of 2.5."""
    (best, name), (second, _) = family_scores(samples)[:2]
    if best < 2.5:
        return "unknown", None, round(min(best / 10, 0.3), 3)
    ambiguous = second >= 0.8 * best
    return name, FAMILIES[name][0], round(min(0.95, max(0.25, best / 9 * (0.72 if ambiguous else 1.0))), 3)


def _header_identity(text: str, wire: str) -> tuple[str, str] | None:
    """Vendor and product of the first CEF or LEEF header; a bar after a backslash belongs to the value."""
    found = re.search({"cef": "CEF:", "leef": "LEEF:"}[wire] + r"(?:[^|\\]|\\.)*\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|", text)
    plain = lambda x: re.sub(r"\\(.)", r"\1", x).strip()
    return (plain(found[1]), plain(found[2])) if found and plain(found[1]) and plain(found[2]) else None


def hypotheses(samples: list[str], wire: str) -> list[dict]:
    """Products that literals or a header speak for, by confidence; of equals that follow each other the first."""
    text = "\n".join(samples)
    found = [{"vendor": v, "product": p, "confidence": c, "evidence": list(marks)} for marks, v, p, c in SIGNATURES if all(m in text.lower() for m in marks)]
    if wire in ("cef", "leef"):
        named = _header_identity(text, wire)
        vendor, product, sure = (*named, 0.99) if named else ("Unknown", wire.upper(), 0.65)
        found.append({"vendor": vendor, "product": product, "confidence": sure, "evidence": [f"{wire} header"]})
    found.sort(key=lambda h: -h["confidence"])
    return [h for i, h in enumerate(found) if i == 0 or (h["vendor"], h["product"]) != (found[i - 1]["vendor"], found[i - 1]["product"])]


def profile(samples: list[str]) -> dict:
    """Evidence on a source from at most 100 lines: format, decoders, family, class and product hypotheses, warnings and the next step."""
    lines = [s for s in samples if s and s.strip()][:100]
    fmt, confidence = wire_format(lines)
    name, class_uid, sure = family(lines)
    products = hypotheses(lines, fmt)
    warnings = [w for w, holds in (("few samples", len(lines) < 5), ("no field names", not field_names(lines)), ("no family", name == "unknown"), ("no product", not products)) if holds]
    return {
        "samples": len(lines), "wire_format": fmt, "format_confidence": round(confidence, 3), "decoders": infer_decoders(lines), "family": name, "class_uid": class_uid, "family_confidence": sure,
        "hypotheses": products, "warnings": warnings, "next_step": "review the draft" if products and products[0]["confidence"] >= NAME_FROM else "name vendor and product",
    }


def profiles(clusters: DataFrame) -> DataFrame:
    """``(cluster_id, n, profile)``: the profile of every cluster's samples, as JSON."""
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["cluster_id"] for r in rows], pa.string()), pa.array([r["n"] for r in rows], pa.int64()), pa.array([json.dumps(profile(r["samples"] or [])) for r in rows], pa.string())], names=["cluster_id", "n", "profile"])

    return clusters.select("cluster_id", "n", "samples").mapInArrow(run, "cluster_id string, n bigint, profile string")


# --- drafting -------------------------------------------------------------------------------------


def is_stable(token: str) -> bool:
    """Whether a literal may identify a source: 3 to 40 characters, no long digit run, clock or calendar word."""
    if not 3 <= len(token) <= 40 or re.search(r"\d{3}|\d:\d\d", token):
        return False
    if re.fullmatch(r"(?i)(?:mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", token):
        return False
    return len(token) >= 8 or bool(re.search(r"[^A-Za-z0-9]", token))


def is_volatile(token: str) -> bool:
    """Whether a token varies between records of one shape: three digits in a row, or digits and a colon."""
    return bool(re.search(r"\d{3}", token)) or ":" in token and bool(re.search(r"\d", token))


def is_field_key(key: str) -> bool:
    """Whether what stands before ``=`` is a field's name and no prose."""
    return bool(re.fullmatch(r"(?=.*[A-Za-z])[A-Za-z0-9_.-]{1,40}", key))


def slug(text: str) -> str:
    """A safe and readable stem of a file name."""
    return re.sub(r"[^A-Za-z0-9]+", "-", text).strip("-").lower()


def suggested_id(samples: list[str], wire: str, key: str) -> str:
    """An id for a draft: of the first stable word that all samples have, for a tag stands early; else of the cluster."""
    for token in samples[0].split() if samples else ():
        name, eq, _ = token.partition("=")
        bare = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", token)
        if not (eq and is_field_key(name)) and is_stable(bare) and all(bare in s for s in samples) and slug(token):
            return f"{slug(token)}-{slug(wire)}"
    return f"unknown-{slug(wire)}-{slug(key)}"


def shared_tokens(samples: list[str], most: int = 3) -> list[str]:
    """Stable tokens that every sample has, longest first; of ``key=value`` the ``key=``."""
    keep = lambda s: {m + "=" if eq else m for m, eq, _ in (t.partition("=") for t in SPLIT.split(s) if t)}
    sets = [keep(s) for s in samples]
    common = set.intersection(*sets) if sets else set()
    return sorted((t for t in common if is_stable(t)), key=lambda t: (-len(t), t))[:most]


def detector_tokens(samples: list[str], most: int = 3) -> list[str]:
    """Words of the first sample that identify the source and stand in all others: markers before names of fields, long before short."""
    found: set[str] = set()
    for token in samples[0].split() if samples else ():
        key, eq, _ = token.partition("=")
        if eq and is_field_key(key):
            found.add(f"{key}=")
        elif is_stable(token):
            found.add(token)
    return sorted((t for t in found if all(t in s for s in samples)), key=lambda t: (t.endswith("="), -len(t), t))[:most]


def common_phrase(samples: list[str]) -> str | None:
    """The longest run of at least two words, with a letter, six characters and no three digits in a row, that every sample holds."""
    words, best = samples[0].split() if samples else [], None
    for start in range(len(words)):
        for end in range(start + 2, len(words) + 1):
            phrase = " ".join(words[start:end])
            if not all(phrase in s for s in samples):
                break
            if len(phrase) >= 6 and re.search("[A-Za-z]", phrase) and not re.search(r"\d{3}", phrase) and (best is None or len(phrase) > len(best)):
                best = phrase
    return best


def detector(samples: list[str]) -> tuple[list[str], list[str]]:
    """Literals that identify a source, and the samples they claim.

    Tokens that all samples have; else a phrase that all have; else the phrase of some two
    samples that most have, made longer if those allow; else a placeholder that claims none.
    """
    literals = detector_tokens(samples) or [p for p in (common_phrase(samples),) if p]
    if literals:
        return literals, list(samples)
    few = samples[:PAIRED]
    pairs = {p for i, a in enumerate(few) for b in few[i + 1 :] if (p := common_phrase([a, b]))}
    hits, _, phrase = max(((sum(p in s for s in samples), len(p), p) for p in sorted(pairs, reverse=True)), default=(0, 0, ""), key=lambda x: x[:2])
    if hits < 2 or 2 * hits <= len(samples):
        return [PLACEHOLDER], []
    longer = common_phrase([s for s in samples if phrase in s])
    phrase = longer if longer and len(longer) > len(phrase) else phrase
    return [phrase], [s for s in samples if phrase in s]


#: Which source names map to which target, in order.
FIELD_RULES = [
    ("src_endpoint.port", ("srcport", "sport", "spt", "sourceport", "sourceportnumber"), "int", None), ("dst_endpoint.port", ("dstport", "dport", "dpt", "destport", "destinationport"), "int", None),
    ("src_endpoint.ip", ("src", "srcip", "sourceip", "sourceaddress", "clientip", "saddr"), None, "ip"), ("dst_endpoint.ip", ("dst", "dstip", "destip", "destinationip", "destinationaddress", "daddr"), None, "ip"),
    ("connection_info.protocol_name", ("proto", "protocol", "protocolname"), None, None), ("device.hostname", ("sysloghostname", "hostname", "host", "devname", "device"), None, "hostname"),
    ("actor.user.name", ("user", "username", "account", "suser", "duser"), None, "user"), ("url.url_string", ("url", "request", "uri"), None, "url"), ("message", ("msg", "message", "syslogbody"), None, None),
]


def infer_map(fields: list[str]) -> dict:
    """Targets for the fields whose normalised names are known; each source is used once."""
    out, used = {}, set()
    for target, names, kind, observable in FIELD_RULES:
        for f in fields:
            if f not in used and re.sub(r"[^a-z0-9]", "", f.lower()) in names:
                out[target] = {"from": f} | ({"as": kind} if kind else {}) | ({"observable": observable} if observable else {})
                used.add(f)
                break
    return out


def class_accepts(class_uid: int, path: str) -> bool:
    """Whether a class has the first member of a target; a class that is not listed has only the first three targets."""
    return path in KNOWN_PATHS[:3] or path.split(".")[0] in CLASS_ROOTS.get(class_uid, ())


def unknown_paths(mapping: dict) -> list[str]:
    """Targets of a map that drafts may not have."""
    return sorted(set(mapping) - set(KNOWN_PATHS))


def _fields_of(spec: dict, sample: str) -> list[str]:
    from ..packs.spec import parse_pack

    return sorted(Engine([parse_pack(yaml.safe_dump(spec))], 2000).event(sample.encode(), None, None)["fields"] or {})


def _claims_itself(spec: dict, samples: list[str]) -> bool:
    from ..packs.spec import parse_pack

    engine = Engine([parse_pack(yaml.safe_dump(spec))], 2000)
    return all(engine.event(s.encode(), None, None)["disposition"] == "parsed" for s in samples)


def _observed(spec: dict, sample: str) -> dict:
    """What a draft makes of a sample, target by target: the expectations of its fixture."""
    from ..packs.spec import parse_pack

    event = json.loads(Engine([parse_pack(yaml.safe_dump(spec))], 2000).event(sample.encode(), None, None)["event_json"])
    out = {}
    for path in spec["map"]:
        value = event
        for p in path.split("."):
            value = value.get(p) if isinstance(value, dict) else None
        if value is not None:
            out[path] = value
    return out


def draft(samples: list[str], key: str) -> dict | None:
    """A baseline candidate for a cluster, None where its lines share no stable literal or the draft fails on them.

    Candidates have priority 1000, class 4001, activity 1, optional steps and unknown vendor: a person approves them.
    """
    marks = shared_tokens(samples)
    if not marks:
        return None
    steps = [s | {"optional": True} for s in infer_decoders(samples)]
    cluster_hash = f"cluster-{fnv1a(key.encode()):016x}"
    spec = {
        "identity": {"id": f"draft-{cluster_hash[8:]}", "vendor": "Unknown", "product": "Unknown", "log_format": wire_format(samples)[0], "priority": 1000, "detect": [{"contains_all": marks}]},
        "extract": steps, "map": {"class_uid": 4001, "activity_id": 1, "severity_id": 1}, "provenance": {"cluster_id": cluster_hash, "approval_required": True},
    }
    spec["map"] |= infer_map(_fields_of(spec, samples[0]))
    if not _claims_itself(spec, samples):
        return None
    spec["fixtures"] = [{"raw": samples[i], "expect": {"class_uid": 4001}} for i in diverse_indices(samples, 3)]
    return spec


def draft_from_evidence(samples: list[str], key: str) -> dict:
    """A candidate from a source's profile, with its score on its own fixtures under ``provenance``.

    It names a product only on a hypothesis of at least NAME_FROM, and takes its family's class
    only on a confidence of at least CLASS_FROM and if the class has all that is mapped. Steps are
    required and the activity is unknown. Fixtures are taken of the samples that the detector claims.
    """
    evidence = profile(samples)
    literals, claimed = detector(samples)
    named = next((h for h in evidence["hypotheses"][:1] if h["confidence"] >= NAME_FROM), {"vendor": "Unknown", "product": "Unknown"})
    spec = {
        "identity": {"id": suggested_id(samples, evidence["wire_format"], key), "vendor": named["vendor"], "product": named["product"], "log_format": evidence["wire_format"], "priority": 1000, "detect": [{"contains_all": literals}]},
        "extract": evidence["decoders"], "map": {"class_uid": 4001, "activity_id": 0, "severity_id": 1},
    }
    found = _fields_of(spec, claimed[0]) if claimed else []
    spec["map"] |= {path: rule for path, rule in infer_map(found or field_names(samples)).items() if path in KNOWN_PATHS}
    suggested = evidence["class_uid"] if evidence["family_confidence"] >= CLASS_FROM else None
    if suggested and all(class_accepts(suggested, p) for p in spec["map"]):
        spec["map"]["class_uid"] = suggested
    spec["fixtures"] = [{"raw": claimed[i], "expect": _observed(spec, claimed[i])} for i in diverse_indices(claimed, 3)]
    report = check_pack(yaml.safe_dump(spec, allow_unicode=True))
    return spec | {"provenance": {"cluster_id": f"cluster-{fnv1a(key.encode()):016x}", "approval_required": True, "unclaimed": len(samples) - len(claimed), "fixtures_passed": report["passed"], "fixtures": report["fixtures"]}}


def drafts(clusters: DataFrame, max_clusters: int = 20, how=draft) -> list[dict]:
    """Candidate packs of the most frequent clusters, a top-k report; at most 30 samples each come to the driver."""
    rows = clusters.where(F.col("template").isNotNull()).orderBy(F.desc("n"), "cluster_id").limit(max_clusters).collect()
    found = ((r, how(list(r.samples), " ".join(r.template))) for r in rows)
    return [d | {"records": r.n} for r, d in found if d]


def profile_lines(lines: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """The profile of every cluster of lines, by volume."""
    return profiles(cluster(lines, text, seq)).orderBy(F.desc("n"), "cluster_id")


def draft_lines(lines: DataFrame, folder: str, source: str, text: str = "text", seq: str = "seq", max_clusters: int = 20, how=draft) -> str:
    """Unknown lines to candidate packs in a folder, of the most frequent clusters; returns the manifest's path."""
    found = drafts(cluster(lines, text, seq), max_clusters, how)
    return write_drafts(found, folder, source, lines.count())


def sidecar(command: list[str], timeout: float = 60.0):
    """``how`` for ``drafts``: a program that reads samples and cluster as JSON and writes a pack as YAML; a pack that fails its checks counts as none."""
    def how(samples: list[str], key: str) -> dict | None:
        asked = json.dumps({"cluster_id": f"cluster-{fnv1a(key.encode()):016x}", "samples": samples})
        answer = subprocess.run(command, input=asked, capture_output=True, text=True, timeout=timeout, check=True).stdout
        return yaml.safe_load(answer) if check_pack(answer)["ok"] else None

    return how


def safe_stem(pack_id: str) -> str:
    """A file name for a pack: other characters than letters, digits, ``-_.`` become ``_``, dots at the ends go; nothing or over 128 is an error."""
    stem = re.sub(r"[^A-Za-z0-9_.-]", "_", pack_id).strip(".")
    if not stem or len(stem) > 128:
        raise ValueError(f"{pack_id!r} gives no file name")
    return stem


def check_pack(text: str) -> dict:
    """``ok, id, fixtures, passed, problems`` of a pack in the making; nothing is written and nothing raised."""
    from ..packs.spec import PackError, parse_pack

    try:
        pack = parse_pack(text)
        report = run_fixtures([pack])[0]
    except (PackError, yaml.YAMLError, ValueError, TypeError, AttributeError, KeyError) as error:
        return {"ok": False, "id": None, "fixtures": 0, "passed": 0, "problems": [str(error)]}
    problems = [] if report["passed"] == report["fixtures"] else ["fixtures fail"]
    return {"ok": not problems, "id": pack.id, "fixtures": report["fixtures"], "passed": report["passed"], "problems": problems}


def approve_pack(text: str, folder: str) -> str:
    """The path of a pack written to a library; refused, with nothing written, if it does not compile or fails a fixture."""
    report = check_pack(text)
    if not report["ok"]:
        raise ValueError(f"not approved: {report['problems']}")
    path = os.path.join(folder, f"{safe_stem(report['id'])}.yaml")
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.part", path)
    return path


def write_drafts(candidates: list[dict], folder: str, source: str, records_read: int, generator: str = "template") -> str:
    """Candidates as ``<id>.yaml`` and a ``manifest.json`` that says what they are of; returns the manifest's path.

    Every file is checked after it is written; one that fails its own fixtures is an error.
    """
    os.makedirs(folder, exist_ok=True)
    listed = []
    for found in candidates:
        spec = {k: v for k, v in found.items() if k != "records"}
        path = os.path.join(folder, f"{safe_stem(spec['identity']['id'])}.yaml")
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(spec, f, sort_keys=False, allow_unicode=True)
        with open(path, encoding="utf-8") as f:
            if not (report := check_pack(f.read()))["ok"]:
                raise ValueError(f"{path}: {report['problems']}")
        listed.append({"id": spec["identity"]["id"], "records": found.get("records"), "detector": spec["identity"]["detect"][0]["contains_all"], "candidate": path})
    manifest = os.path.join(folder, "manifest.json")
    with open(manifest, "w", encoding="utf-8") as f:
        json.dump({"source": source, "generator": generator, "records_read": records_read, "clusters": listed, "approval_required": True}, f, indent=2)
    return manifest


def run_fixtures(packs) -> list[dict]:
    """Per pack: fixtures and assertions, total and passed; a fixture that another pack claims fails."""
    engine, out = Engine(packs, 2000), []
    for pack in packs:
        good = asserts = passed = 0
        for f in pack.fixtures:
            got = engine.event(f["raw"].encode(), 0, None)
            event, ok = json.loads(got["event_json"]), got["pack_id"] == pack.id
            for path, want in (f.get("expect") or {}).items():
                value = event
                for p in path.split("."):
                    value = value.get(p) if isinstance(value, dict) else None
                asserts += 1
                passed += values_match(value, want)
                ok = ok and values_match(value, want)
            good += ok
        out.append({"pack": pack.id, "fixtures": len(pack.fixtures), "passed": good, "assertions": asserts, "assertions_passed": passed})
    return out


def shadowed(packs) -> list[tuple[str, str]]:
    """``(pack, winner)`` of packs a fixture of which another pack claims."""
    engine = Engine(packs, 2000)
    won = ((p.id, engine.event(f["raw"].encode(), 0, None)["pack_id"]) for p in packs for f in p.fixtures)
    return sorted({(own, winner) for own, winner in won if winner is not None and winner != own})


def values_match(got, want) -> bool:
    """Whether a value is the one expected: equal, or a number and a text that read the same."""
    if isinstance(got, str) != isinstance(want, str) and not isinstance(got, bool) and not isinstance(want, bool):
        return str(got) == str(want)
    return type(got) is type(want) and got == want or isinstance(got, (int, float)) and isinstance(want, (int, float)) and not isinstance(got, bool) and not isinstance(want, bool) and got == want


def coverage_regression(measured: DataFrame, baseline: DataFrame, tolerance: float = 0.0005) -> DataFrame:
    """``(corpus, was, now, verdict)`` of ``(corpus, parsed_share)`` against a recorded baseline.

    ``lost`` where the share fell by more than the tolerance, ``missing`` where a corpus was not
    measured, ``new`` where it has no record, else ``kept``. The total is a corpus like others.
    """
    was, now = F.col("b.parsed_share"), F.col("m.parsed_share")
    verdict = F.when(now.isNull(), "missing").when(was.isNull(), "new").when(now < was - tolerance, "lost").otherwise("kept")
    joined = baseline.alias("b").join(measured.alias("m"), F.col("b.corpus") == F.col("m.corpus"), "full")
    return joined.select(F.coalesce("b.corpus", "m.corpus").alias("corpus"), was.alias("was"), now.alias("now"), verdict.alias("verdict"))
