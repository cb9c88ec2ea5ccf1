"""Mixed timestamp formats and zones to one instant: nanoseconds UTC.

An ordered cascade of anchored patterns picks the layout of an entry's stamp and rewrites it
to one canonical form; fields are then checked strictly and turned to seconds by calendar
arithmetic. A written zone, offset or epoch number decides; else the zone of the source. Clock
readings that occur twice, and missing years, go to the instant nearest to the receipt;
readings that no clock showed (a spring gap) are read with the offset before the change.
Everything is JVM-side expressions: no Python, no shuffle beyond the caller's.
"""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DAYS = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_HMS = r"(\d{1,2}):(\d\d)(?::(\d\d))?"
_FRAC = r"(?:[.,](\d{1,12}))?"
_ZONE = r"(Z|[+-]\d\d(?::?\d\d)?)?"

#: Offsets in seconds of the zone abbreviations that stamps carry.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 3600, "BST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800,
    "MSK": 10800, "IST": 19800, "NPT": 20700, "JST": 32400, "KST": 32400, "AWST": 28800, "ACST": 34200, "ACDT": 37800,
    "AEST": 36000, "AEDT": 39600, "NZST": 43200, "NZDT": 46800, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000,
    "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200, "AKST": -32400, "AKDT": -28800, "HST": -36000,
}

# Each pattern is anchored; the replacement gives year|month|day|hour|minute|second|fraction|zone|half.
# Whatever may precede a stamp is taken possessively and in one way only, so that a line of any
# length and any number of pairs is read once.
_ISO = rf"(\d{{4}})[-/](\d\d)[-/](\d\d)[T ]{_HMS}{_FRAC} ?{_ZONE}"
_BASIC = rf"(\d{{4}})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)?{_FRAC}{_ZONE}"
_EPOCH = r"(\d{9,19})(?:\.(\d{1,9}))?"
_KEY = "(?:time|ts|timestamp|datetime)"
_MEMBER_KEY = '"(?:time|@timestamp|timestamp|ts|eventTime|event_time|datetime)"'
_STRING = r'"(?:[^"\\]|\\.)*+"'
_DATE_FIELDS = "$1|$2|$3|$4|$5|$6|$7|$8|"
_EPOCH_FIELDS = "$1||||||$2|EPOCH|"


def _nested(depth: int) -> str:
    """A JSON object or array with objects and arrays in it to the given depth."""
    inner = f"|{_nested(depth - 1)}" if depth else ""
    return rf'[\[{{](?:[^\[\]{{}}"]++|{_STRING}{inner})*+[\]}}]'


def _after_pairs(stamp: str, end: str) -> str:
    """``key=value`` pairs up to the first time key with such a stamp, and the stamp."""
    at = rf'{_KEY}="?'
    ahead = re.sub(r"\((?!\?)", "(?:", stamp)
    return rf'\A(?:(?!{at}{ahead}{end})[\w.@/-]++=(?:{_STRING}|[^"\s]\S*+|) ++)*+{at}{stamp}{end}'


def _after_members(stamp: str, end: str) -> str:
    """Members of a JSON object up to the first time member with such a stamp, and the stamp."""
    at = rf'{_MEMBER_KEY}\s*+:\s*+"?'
    ahead = re.sub(r"\((?!\?)", "(?:", stamp)
    return rf'\A\s*+\{{\s*+(?:(?!{at}{ahead}{end}){_STRING}\s*+:\s*+(?:{_STRING}|[-+\w.]++|{_nested(3)})\s*+,\s*+)*+{at}{stamp}{end}'


CASCADE: list[tuple[str, str, str]] = [
    ("rfc5424", rf"\A<\d{{1,3}}>\d{{1,2}} {_ISO}(?= )", _DATE_FIELDS),
    ("rfc3164", rf"\A(?:<\d{{1,3}}>)?{MONTHS} +(\d{{1,2}})(?: (\d{{4}}))? {_HMS}{_FRAC}(?=[ :])", "$3|$1|$2|$4|$5|$6|$7||"),
    ("jul", rf"\A{MONTHS} +(\d{{1,2}}), (\d{{4}}),? {_HMS}{_FRAC} ([AP]M)(?=\s)", "$3|$1|$2|$4|$5|$6|$7||$8"),
    ("apache", rf"\A\[{DAYS} {MONTHS} +(\d{{1,2}}) {_HMS}{_FRAC} (\d{{4}})\]", "$7|$1|$2|$3|$4|$5|$6||"),
    ("ctime", rf"\A{DAYS} {MONTHS} +(\d{{1,2}}) {_HMS}{_FRAC}(?: ([A-Z]{{1,5}}|[+-]\d\d(?::?\d\d)?))? (\d{{4}})(?=\s)", "$8|$1|$2|$3|$4|$5|$6|$7|"),
    ("mail", rf"\A{DAYS}, +(\d{{1,2}}) {MONTHS} (\d{{4}}) {_HMS}{_FRAC}(?: ([A-Z]{{1,5}}|[+-]\d\d(?::?\d\d)?))?(?=\s)", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    ("clf", rf"\A\S++ \S++ \S++ \[(\d\d)/{MONTHS}/(\d{{4}}):{_HMS}(?: {_ZONE})?\]", "$3|$2|$1|$4|$5|$6||$7|"),
    ("glog", rf"\A[DIWEFC](\d\d)(\d\d) +{_HMS}{_FRAC}(?=\s)", "|$1|$2|$3|$4|$5|$6||"),
    ("logcat", rf"\A(\d\d)-(\d\d) {_HMS}{_FRAC}(?=\s)", "|$1|$2|$3|$4|$5|$6||"),
    ("iso", rf"\A\[?{_ISO}(?=[\s,\]]|\z)", _DATE_FIELDS),
    ("iso_basic", rf"\A\[?{_BASIC}(?=[\s,\]]|\z)", _DATE_FIELDS),
    ("short", rf"\A(\d\d)/(\d\d)/(\d\d) {_HMS}{_FRAC}(?=\s)", "$1|$2|$3|$4|$5|$6|$7||YY"),
    ("dense", rf"\A(\d\d)(\d\d)(\d\d) (\d\d)(\d\d)(\d\d){_FRAC}(?=\s)", "$1|$2|$3|$4|$5|$6|$7||YY"),
    ("dotted", rf"\A(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_HMS}{_FRAC}(?=[\s|])", "$3|$2|$1|$4|$5|$6|$7||"),
    ("epoch", rf"\A{_EPOCH}(?=\s)", _EPOCH_FIELDS),
    ("logfmt", _after_pairs(_ISO, r'"?(?=\s|\z)'), _DATE_FIELDS),
    ("logfmt_basic", _after_pairs(_BASIC, r'"?(?=\s|\z)'), _DATE_FIELDS),
    ("logfmt_epoch", _after_pairs(_EPOCH, r'"?(?=\s|\z)'), _EPOCH_FIELDS),
    ("json", _after_members(_ISO, '"'), _DATE_FIELDS),
    ("json_basic", _after_members(_BASIC, '"'), _DATE_FIELDS),
    ("json_epoch", _after_members(_EPOCH, r'"?(?=[\s,}])'), _EPOCH_FIELDS),
]

NS = 1_000_000_000


def canonical(text: Column) -> Column:
    """``format|year|month|day|hour|minute|second|fraction|zone|half`` of the first pattern that holds, or null."""
    out = F
    for name, pattern, fields in CASCADE:
        out = out.when(text.rlike(pattern), F.regexp_replace(text, rf"(?s){pattern}.*\z", f"{name}|{fields}"))
    return out


def receipt_ns(received: Column) -> Column:
    """A receipt clock of seconds, milli-, micro- or nanoseconds, by magnitude, in nanoseconds."""
    size = F.abs(received)
    return (
        F.when(size < 100_000_000_000, F.try_multiply(received, F.lit(NS)))
        .when(size < 100_000_000_000_000, F.try_multiply(received, F.lit(1_000_000)))
        .when(size < 100_000_000_000_000_000, F.try_multiply(received, F.lit(1_000)))
        .otherwise(received)
    )


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _local_seconds(y: Column, m: Column, d: Column, clock: Column) -> Column:
    """Wall-clock seconds, null for a date that does not exist."""
    first = _days(y, m, F.lit(1))
    nxt = _days(F.when(m == 12, y + 1).otherwise(y), F.when(m == 12, 1).otherwise(m + 1), F.lit(1))
    return F.when(m.between(1, 12) & (d >= 1) & (d <= nxt - first), (first + d - 1) * 86400 + clock)


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with computed columns that the optimizer keeps as computed once.

    They come out of a one-row generator, through which neither projections are merged nor
    filters pushed; merged, the calendar arithmetic would repeat itself without bound.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def stated_instant(df: DataFrame, text: str, received_at: str, zone: str, out: str = "stated_ns") -> DataFrame:
    """``df`` with the instant that ``text`` states, in ns UTC, and ``<out>_format``.

    Null where no pattern holds, or the fields are no date and clock that exist. ``zone`` is
    the IANA zone of the source, null for UTC. A null receipt takes the first reading of a
    clock that shows twice, and leaves a missing year unresolved (null).
    """
    part = lambda i: F.col("_p")[i]
    number = lambda i: F.expr(f"try_cast(nullif(_p[{i}], '') as bigint)")
    kept = df.columns

    staged = _bound(df, _c=canonical(F.col(text)), _near=(receipt_ns(F.col(received_at)) / NS).cast("bigint"))
    staged = _bound(staged, _p=F.split("_c", r"\|"), _year0=F.year(F.timestamp_seconds("_near")).cast("bigint"))

    hour, half, mark = number(4), part(9), part(8)
    hour24 = F.when(half == "PM", F.when(hour == 12, 12).otherwise(hour + 12)).when(half == "AM", F.when(hour == 12, 0).otherwise(hour)).otherwise(hour)
    hour_ok = F.when(half.isin("AM", "PM"), hour.between(1, 12)).otherwise(hour.between(0, 23))
    minute, second = number(5), F.coalesce(number(6), F.lit(0))
    digits = F.regexp_replace(mark, ":", "")
    numeric = F.when(digits.startswith("-"), -1).otherwise(1) * (
        F.substring(digits, 2, 2).try_cast("bigint") * 3600 + F.coalesce(F.substring(digits, 4, 2).try_cast("bigint"), F.lit(0)) * 60
    )
    named = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])[mark]
    named_month = ((F.expr("instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(_p[2]))") + 2) / 3).cast("bigint")
    staged = _bound(
        staged,
        _y=F.when(half == "YY", number(1) + 2000).otherwise(number(1)),
        _m=F.when(part(2).rlike("^[A-Z]"), named_month).otherwise(number(2)),
        _d=number(3),
        _clock=F.when(hour_ok & minute.between(0, 59) & second.between(0, 59), hour24 * 3600 + minute * 60 + second),
        _offset=F.when(mark.rlike(r"^[+-]\d"), numeric).otherwise(named),
    )
    # One candidate year where it is written, three where it is not.
    years = [F.coalesce("_y", "_year0"), *[F.when(F.col("_y").isNull(), F.col("_year0") + k) for k in (-1, 1)]]
    staged = _bound(staged, **{f"_y{k}": y for k, y in enumerate(years)})
    staged = _bound(staged, **{f"_l{k}": _local_seconds(F.col(f"_y{k}"), F.col("_m"), F.col("_d"), F.col("_clock")) for k in range(3)})
    zone_or_utc = F.coalesce(F.col(zone), F.lit("UTC"))
    utc = lambda k: F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(f"_l{k}"), zone_or_utc))
    staged = _bound(
        staged, **{f"_u{k}": F.when(F.col("_offset").isNotNull(), F.col(f"_l{k}") - F.col("_offset")).otherwise(utc(k)) for k in range(3)}
    )

    def again(k: int) -> Column:
        """The second instant of a clock reading that shows twice, or null."""
        back = lambda later: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(F.col(f"_u{k}") + later), zone_or_utc))
        found = F.coalesce(*[F.when(back(later) == F.col(f"_l{k}"), F.col(f"_u{k}") + later) for later in (1800, 3600, 7200)])
        return F.when(F.col("_offset").isNull(), found)

    staged = _bound(staged, **{f"_a{k}": again(k) for k in range(3)})
    far = lambda c: F.coalesce(F.abs(F.col(c) - F.col("_near")), F.lit(0).cast("bigint")).alias("far")
    tries = F.array(*[F.struct(far(c), F.col(c).alias("at")) for c in ("_u0", "_a0", "_u1", "_a1", "_u2", "_a2")])
    seconds = F.array_min(F.filter(tries, lambda t: t["at"].isNotNull()))["at"]
    fraction = F.rpad(F.substring(part(7), 1, 9), 9, "0").cast("bigint")
    size = F.length(part(1))
    epoch = (
        F.when(size <= 11, F.try_add(F.try_multiply(F.col("_y"), F.lit(NS)), fraction))
        .when(size <= 14, F.try_multiply(F.col("_y"), F.lit(1_000_000)))
        .when(size <= 17, F.try_multiply(F.col("_y"), F.lit(1_000)))
        .otherwise(F.col("_y"))
    )
    stated = F.when(mark == "EPOCH", epoch).otherwise(F.try_add(F.try_multiply(seconds, F.lit(NS)), fraction))
    return _bound(staged, **{out: stated, f"{out}_format": part(0)}).select(*kept, out, f"{out}_format")


def with_zone(df: DataFrame, devices: DataFrame) -> DataFrame:
    """``df`` with ``source_zone``: that of the device with its peer, else of the one with its origin.

    Unknown zone names count as UTC. Of several devices the one with the lowest id counts. The
    session joins the devices by broadcast where their size is within its bound, else by shuffle.
    """
    names = F.array(*[F.lit(z) for z in sorted(zoneinfo.available_timezones() - {"localtime"})])
    known = devices.select("device_id", "peer_ip", "origin_path", F.when(F.array_contains(names, F.col("zone_name")), F.col("zone_name")).otherwise("UTC").alias("zone"))

    def by(key: str, name: str) -> DataFrame:
        return known.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.min_by("zone", "device_id").alias(f"_zone_{name}"))

    return (
        df.join(by("peer_ip", "peer"), "peer", "left")
        .join(by("origin_path", "origin"), "origin", "left")
        .withColumn("source_zone", F.coalesce("_zone_peer", "_zone_origin"))
        .drop("_zone_peer", "_zone_origin")
    )


def wrong_instants(raw: DataFrame, devices: DataFrame, features: DataFrame) -> DataFrame:
    """``(event_uid, time_ns)``: events whose stored time is not exactly what their entry states.

    Of several entries of an event the one with the lowest raw_id counts. Entries without a
    readable time are no case. A null stored time is not what the entry states.
    """
    from .entries import assemble

    entries = assemble(raw).where(F.col("event_uid").isNotNull())
    first = entries.groupBy("event_uid").agg(F.min_by(F.struct("text", "received_at", "peer", "origin"), "raw_id").alias("e")).select("event_uid", "e.*")
    stated = stated_instant(with_zone(first, devices), "text", "received_at", "source_zone").where(F.col("stated_ns").isNotNull())
    stored = features.select("event_uid", F.col("time_ns").alias("stored"))
    return (
        stated.select("event_uid", "stated_ns")
        .join(stored, "event_uid")
        .where(~F.col("stored").eqNullSafe(F.col("stated_ns")))
        .select("event_uid", F.col("stated_ns").alias("time_ns"))
        .distinct()
    )
