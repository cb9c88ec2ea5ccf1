"""Log entries of differing programs to timestamp, level, component and message.

A weighted context-free grammar describes headers, their fields and continuation lines; the
Earley parser keeps the highest-scoring parse of each entry. Spans that only the catch-all
rules cover, or that lie beyond the parse, are returned as unparsed. Parsing is row-local
(Arrow batches, no shuffle); only the assembly of entries from records before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.earley import Grammar, parse
from .entries import assemble, n_lines

#: Level names, letters and syslog severities.
LEVELS = {
    "DEBUG": ("debug", "trace", "verbose", "fine", "finer", "finest", "dbg", "d", "t", "v"),
    "INFO": ("info", "notice", "config", "information", "informational", "i", "n", "c"),
    "WARN": ("warn", "warning", "w"),
    "ERROR": ("error", "err", "severe", "e", "s"),
    "FATAL": ("fatal", "crit", "critical", "alert", "emerg", "emergency", "panic", "f", "a"),
}
LEVEL_OF = {name: level for level, names in LEVELS.items() for name in names}
SEVERITY = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")

_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DOW = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_HMS = r"\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?"
_EOL = r"(?:\r\n?|\n)"
_END = r"(?:\r\n?|\n|\Z)"
_WORDS = "|".join(sorted((n for names in LEVELS.values() for n in names if len(n) > 1), key=len, reverse=True))
_STR = r'"(?:[^"\\]|\\.)*"'
_KEY_LEVEL = "(?:level|lvl|severity|loglevel|levelname)"
_KEY_COMP = "(?:component|module|logger|app|application|program|class|tag|source)"
_KEY_TIME = "(?:time|@timestamp|timestamp|ts|eventTime|event_time)"
_KEY_MSG = "(?:msg|message)"

TERMINALS = {
    # times
    "T3164": rf"{_MON} {{1,2}}\d{{1,2}}(?: \d{{4}})? {_HMS} ",
    "T5424": rf"\d{{1,2}} (?:\d{{4}}-\d\d-\d\dT{_HMS}(?:Z|[+-]\d\d:?\d\d)?|-) ",
    "TAPACHE": rf"\[{_DOW} {_MON} +\d{{1,2}} {_HMS} \d{{4}}\] ",
    "TCTIME": rf"{_DOW} {_MON} +\d{{1,2}} {_HMS}(?: [A-Z]{{1,5}}| [+-]\d\d:?\d\d)? \d{{4}} ",
    "TISO": rf"\d{{4}}-\d\d-\d\d[ T]{_HMS}(?:Z|[+-]\d\d:?\d\d)? ",
    "TCBS": r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d, ",
    "TJUL": rf"{_MON} +\d{{1,2}}, \d{{4}},? {_HMS} [AP]M ",
    "TSHORT": rf"\d\d/\d\d/\d\d {_HMS} ",
    "TDOTTED": rf"\d{{1,2}}\.\d{{1,2}}\.\d{{4}} {_HMS} ",
    "TEPOCH": r"\d{9,19}(?:\.\d+)? ",
    "TCAT": rf"\d\d-\d\d {_HMS} +",
    "TGLOG": rf"\d{{4}} +{_HMS} +",
    "TCLF": rf"\S+ \S+ \S+ \[\d\d/{_MON}/\d{{4}}:{_HMS}(?: [+-]\d{{4}})?\] ",
    # fields
    "PRI": r"<(\d{1,3})>",
    "LEVELWORD": rf"(?i:{_WORDS})(?![\w-])",
    "LEVELLETTER": r"[DIWEFVTNCSA](?=[ \d])",
    "HOST": r"[A-Za-z0-9._:-]+ ",
    "APP": r"\S+",
    "TAG": r"[^\s\[\]:()]{1,128}",
    "FILE": r"[^\s:\[\]]+",
    "CLASS": r"[A-Za-z_$][\w.$/-]*",
    "MODULE": r"[^\s:|\[\]()]+",
    "THREADED": r"\[(?:[^\]\r\n]*:)?(?P<value>[^:@\]\r\n]+)@\d+\] - ",
    # joints
    "SP": r" +",
    "SP1": r" ",
    "PID": r"\[\d+\]",
    "NUM": r"\d+ +",
    "COLON": r": ?",
    "PADCOLON": r" *: ?",
    "DASH": r"- ",
    "BAR": r" *\| *",
    "LB": r"\[",
    "RB": r" *\] ?",
    "LP": r"\(",
    "RPCOLON": r"\): ?",
    "MODCOLON": r":(?=[A-Za-z])",
    "LINENO": r":\d+\] ?",
    "PIDTID": r"\[pid[^\]\r\n]*\] ",
    "MYID": r"\[myid:\d*\] - ",
    "THREAD": r"\[[^\]\r\n]*\] +",
    "METHOD": r" [\w$<>]+",
    "FIELD": r"\S+ ",
    "SD": r'(?:-|(?:\[(?:[^\]"\\]|\\.|"(?:[^"\\]|\\.)*")*\])+)(?: |(?=[\r\n]|\Z))',
    "REQUEST": r'"(?:[^"\\\r\n]|\\.)*" \d{3} (?:\d+|-)',
    "MSG": r"[^\r\n]+",
    "NL": _EOL,
    # key=value pairs
    "PLEVEL": rf'{_KEY_LEVEL}="?(?P<value>\w*)"?(?: +|(?=[\r\n]|\Z))',
    "PCOMP": rf'{_KEY_COMP}=(?:"(?P<value>[^"\r\n]*)"|(?P<bare>[^\s"]*))(?: +|(?=[\r\n]|\Z))',
    "PTIME": rf'{_KEY_TIME}=(?:"[^"\r\n]*"|[^\s"]*)(?: +|(?=[\r\n]|\Z))',
    "PMSG": rf"{_KEY_MSG}=(?:{_STR}|[^\r\n]*)(?: +|(?=[\r\n]|\Z))",
    "PAIR": rf"[\w.@/-]+=(?:{_STR}|[^\s\"]*)(?: +|(?=[\r\n]|\Z))",
    # JSON
    "OPEN": r"\s*\{\s*",
    "CLOSE": r"\s*\}[ \t]*",
    "COMMA": r"\s*,\s*",
    "JLEVEL": rf'"{_KEY_LEVEL}"\s*:\s*"(?P<value>\w*)"',
    "JCOMP": rf'"{_KEY_COMP}"\s*:\s*"(?P<value>(?:[^"\\]|\\.)*)"',
    "JTIME": rf'"{_KEY_TIME}"\s*:\s*(?:{_STR}|[-+\w.]+)',
    "JMSG": rf'"{_KEY_MSG}"\s*:\s*{_STR}',
    "JKEY": rf"{_STR}\s*:\s*",
    "JVALUE": rf"{_STR}|[-+\w.]+",
    "JLB": r"\[\s*",
    "JRB": r"\s*\]",
    # continuation lines
    "LSTACK": rf"[ \t]+(?:at |\.\.\. \d+)[^\r\n]*{_END}",
    "LCAUSE": rf"(?:Caused by: |Suppressed: )?[A-Za-z_$][\w$]*(?:\.[\w$]+)*(?:Exception|Error|Throwable)\b[^\r\n]*{_END}",
    "LTRACE": rf"Traceback \(most recent call last\):{_END}",
    "LINDENT": rf"[ \t]+[^\s][^\r\n]*{_END}",
    "LJSON": rf"[{{}}][^\r\n]*{_END}",
    "LHEX": rf"[0-9a-f]{{8}}  [0-9a-f ]+{_END}",
    "LTABLE": rf"\|[^\r\n]*\|{_END}",
    "LBLANK": rf"[ \t]*{_EOL}",
    "LOTHER": rf"[^\r\n]+{_END}",
}

RULES: list[tuple[str, str, float]] = [
    *[("entry", f"{head} tail?", weight) for head, weight in (
        ("syslog_ietf", 0.0), ("syslog_bsd", -0.5), ("syslog_bare", -1.5), ("apache", 0.0), ("access", 0.0), ("logfmt", -1.0),
        ("ctime", 0.0), ("glog", 0.0), ("threaded", 0.0), ("log4j", -0.5), ("nova", 0.0), ("cbs", 0.0), ("jul", 0.0), ("short", 0.0),
        ("dotted", 0.0), ("bracket", -1.0), ("epoch", -0.5), ("logcat", 0.0), ("json", 0.0), ("plain", -30.0))],
    ("syslog_ietf", "PRI T5424 HOST APP SP1 FIELD FIELD SD MSG?", 0.0),
    ("syslog_bsd", "PRI T3164 HOST TAG PID? COLON MSG?", 0.0),
    ("syslog_bsd", "PRI T3164 HOST MSG", -4.0),
    ("syslog_bare", "T3164 HOST TAG PID? COLON MSG?", 0.0),
    ("apache", "TAPACHE LB MODULE MODCOLON level RB PIDTID? MSG?", 0.0),
    ("apache", "TAPACHE LB level RB PIDTID? MSG?", -1.0),
    ("access", "TCLF REQUEST MSG?", 0.0),
    ("logfmt", "keypair pairs?", 0.0),
    ("pairs", "pair", 0.0),
    ("pairs", "pairs pair", 0.0),
    ("pair", "keypair", 0.0),
    ("pair", "PCOMP", 0.0),
    ("pair", "PMSG", 0.0),
    ("pair", "PAIR", -1.0),
    ("keypair", "PLEVEL", 0.0),
    ("keypair", "PTIME", 0.0),
    ("ctime", "TCTIME TAG LP level RPCOLON MSG?", 0.0),
    ("glog", "LEVELLETTER TGLOG NUM FILE LINENO MSG?", 0.0),
    ("threaded", "TISO MYID level SP THREADED MSG?", 0.0),
    ("log4j", "TISO level SP THREAD? CLASS COLON MSG?", 0.0),
    ("nova", "TISO NUM level SP MODULE SP THREAD MSG?", 0.0),
    ("cbs", "TCBS level SP MODULE SP MSG?", 0.0),
    ("jul", "TJUL CLASS METHOD? NL level COLON MSG?", 0.0),
    ("short", "TSHORT level SP CLASS COLON MSG?", 0.0),
    ("dotted", "TDOTTED BAR? level BAR MODULE BAR MSG?", 0.0),
    ("bracket", "LB level RB MODULE SP DASH MSG?", 0.0),
    ("epoch", "TEPOCH level SP MODULE SP DASH MSG?", 0.0),
    ("logcat", "TCAT NUM NUM LEVELLETTER SP TAG PADCOLON MSG?", 0.0),
    ("level", "LEVELWORD", 0.0),
    ("level", "LEVELLETTER", -1.0),
    ("json", "OPEN members CLOSE", 0.0),
    ("json", "OPEN members", -6.0),
    ("members", "member", 0.0),
    ("members", "members COMMA member", 0.0),
    ("member", "JLEVEL", 0.0),
    ("member", "JCOMP", 0.0),
    ("member", "JTIME", 0.0),
    ("member", "JMSG", 0.0),
    ("member", "any", -1.0),
    ("any", "JKEY value", 0.0),
    ("value", "JVALUE", 0.0),
    ("value", "OPEN inner CLOSE", 0.0),
    ("value", "OPEN CLOSE", 0.0),
    ("value", "JLB items JRB", 0.0),
    ("value", "JLB JRB", 0.0),
    ("inner", "any", 0.0),
    ("inner", "inner COMMA any", 0.0),
    ("items", "value", 0.0),
    ("items", "items COMMA value", 0.0),
    ("plain", "MSG", 0.0),
    ("tail", "NL", 0.0),
    ("tail", "NL lines", 0.0),
    ("tail", "MSG", -8.0),
    ("tail", "MSG NL", -8.0),
    ("tail", "MSG NL lines", -8.0),
    ("lines", "line", 0.0),
    ("lines", "lines line", 0.0),
    *[("line", name, -0.1) for name in ("LSTACK", "LCAUSE", "LTRACE", "LJSON", "LHEX", "LTABLE", "LBLANK")],
    ("line", "LINDENT", -0.5),
    ("line", "LOTHER", -2.0),
]

GRAMMAR = Grammar(TERMINALS, RULES, "entry")
_TIMES = {name for name in TERMINALS if name.startswith("T") and name not in ("TAG", "THREADED", "THREAD")} | {"PTIME", "JTIME"}
_COMPONENT = {"APP", "TAG", "FILE", "CLASS", "MODULE", "THREADED", "PCOMP", "JCOMP"}
_LEVEL = {"LEVELWORD", "LEVELLETTER", "PLEVEL", "JLEVEL"}
_MESSAGE = {"MSG", "PMSG", "JMSG", "REQUEST"}
_FALLBACK = {"LOTHER"}

RESULT = pa.schema([
    ("locator", pa.string()), ("stamp", pa.string()), ("log_level", pa.string()), ("component", pa.string()), ("message", pa.string()),
    ("n_lines", pa.int32()), ("score", pa.float64()), ("unparsed", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
])
RESULT_SCHEMA = (
    "locator string, stamp string, log_level string, component string, message string, n_lines int, score double, "
    "unparsed array<struct<`from`:int,`to`:int>>"
)


def _value(token) -> str:
    groups = token[3].groupdict()
    if groups:
        return next((v for v in groups.values() if v is not None), "")
    return token[3].group()


def read_entry(text: str, grammar: Grammar | None = None) -> dict:
    """Fields of one entry. Empty text has empty fields; text that no header rule fits is all message and unparsed."""
    grammar = (grammar or GRAMMAR).compiled()
    got = parse(grammar, text) if text else None
    stamp = level = component = message = ""
    unparsed: list[tuple[int, int]] = []
    plain = got is None or not any(t[0] in _TIMES or t[0] in _LEVEL or t[0] in ("PRI", "OPEN") for t in got.tokens)
    if plain:
        return {"stamp": "", "log_level": "", "component": "", "message": text, "score": got.score if got else 0.0, "unparsed": [(0, len(text))] if text else []}
    for token in got.tokens:
        name = token[0]
        if name == "PRI" and not level:
            number = int(token[3].group(1))
            level = SEVERITY[number % 8] if number < 192 else ""
        elif name in _LEVEL and not level:
            level = LEVEL_OF.get(_value(token).lower(), "")
        elif name in _COMPONENT and not component:
            component = _value(token)
        elif name in _TIMES and not stamp:
            stamp = token[3].group().strip()
        if name in _MESSAGE and not message:
            message = token[3].group()
        if name in _FALLBACK:
            unparsed.append((token[1], token[2]))
    if got.end < len(text):
        unparsed.append((got.end, len(text)))
    return {"stamp": stamp, "log_level": level, "component": "" if component == "-" else component, "message": message, "score": got.score, "unparsed": unparsed}


def parse_entries(df: DataFrame) -> DataFrame:
    """Fields of every row ``(locator, text, n_lines)``; a null text counts as empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(TERMINALS, RULES, "entry").compiled()
        for batch in batches:
            locators, texts, lines = (batch.column(i).to_pylist() for i in range(3))
            found = [read_entry(t or "", grammar) for t in texts]
            columns = {
                "locator": locators, "n_lines": lines,
                **{k: [f[k] for f in found] for k in ("stamp", "log_level", "component", "message", "score")},
                "unparsed": [[{"from": a, "to": b} for a, b in f["unparsed"]] for f in found],
            }
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in RESULT], schema=RESULT)

    return df.select("locator", "text", "n_lines").mapInArrow(run, RESULT_SCHEMA)


def all_entries(raw: DataFrame, letters: DataFrame) -> DataFrame:
    """``(locator, text, n_lines)`` of every entry of ``raw_events`` and every dead letter without a pack.

    Repeated dead letters stay one row per repetition; an entry that was read twice is two.
    """
    entries = assemble(raw).select("locator", "text", "n_lines")
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    alone = letters.where(F.col("pack").isNull()).select("locator", text.alias("text"), n_lines(text).cast("int").alias("n_lines"))
    return entries.unionByName(alone)


def found_entries(raw: DataFrame, letters: DataFrame) -> DataFrame:
    """``(locator, log_level, component, n_lines)``, distinct."""
    return parse_entries(all_entries(raw, letters)).select("locator", "log_level", "component", "n_lines").distinct()
