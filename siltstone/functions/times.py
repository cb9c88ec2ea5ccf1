"""Time formats that packs name: text to nanoseconds UTC, null where it does not fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.timestamps import MONTHS, NS, _local_seconds
from .values import as_int, let

_CLOCK = r"(\d\d):(\d\d):(\d\d)"
_DATE_TIME = r"^(\d{4})%s(\d\d)%s(\d\d)[ T](\d\d):(\d\d)(?::(\d\d))?(?:\.(\d+))?Z?$"

#: Units of epoch numbers in nanoseconds.
EPOCHS = {"epoch_s": NS, "epoch_ms": 1_000_000, "epoch_us": 1_000, "epoch_ns": 1}
#: Pattern and its rewriting to year|month|day|hour|minute|second|fraction|offset.
FORMATS = {
    "rfc3339": (rf"^(\d{{4}})-(\d\d)-(\d\d)[Tt ]{_CLOCK}(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    "date_time": (_DATE_TIME % ("-", "-"), "$1|$2|$3|$4|$5|$6|$7|"),
    "slash_date_time": (_DATE_TIME % ("/", "/"), "$1|$2|$3|$4|$5|$6|$7|"),
    "rfc3164": (rf"^{MONTHS}\s+(\d{{1,2}})\s+{_CLOCK}$", "|$1|$2|$3|$4|$5||"),
    "clf": (rf"^\[?(\d\d)/{MONTHS}/(\d{{4}}):{_CLOCK}(?:\s([+-]\d{{4}}))?\]?$", "$3|$2|$1|$4|$5|$6||$7"),
}


def parse_time(value: Column, fmt: str, year: int) -> Column:
    """``value`` in ``fmt`` as ns UTC. ``year`` stands for a missing one, so that results do not depend on the clock."""
    if fmt in EPOCHS:
        return F.try_multiply(as_int(value), F.lit(EPOCHS[fmt]).cast("bigint"))
    pattern, to = FORMATS[fmt]

    def instant(p: Column) -> Column:
        number = lambda i: F.nullif(p[i], F.lit("")).try_cast("bigint")
        month = F.when(p[1].rlike("^[A-Z]"), F.floor((F.position(F.lower(p[1]), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("bigint")).otherwise(number(1))
        hour, minute, second = number(3), number(4), F.coalesce(number(5), F.lit(0))
        clock = F.when((hour < 24) & (minute < 60) & (second < 60), hour * 3600 + minute * 60 + second)
        digits = F.replace(p[7], F.lit(":"), F.lit(""))
        offset = F.when(digits.rlike(r"^[+-]\d{4}$"), F.when(digits.startswith("-"), -1).otherwise(1) * (F.substring(digits, 2, 2).try_cast("bigint") * 3600 + F.substring(digits, 4, 2).try_cast("bigint") * 60)).otherwise(F.lit(0))
        seconds = _local_seconds(F.coalesce(number(0), F.lit(year).cast("bigint")), month, number(2), clock)
        return F.try_add(F.try_multiply(seconds - offset, F.lit(NS).cast("bigint")), F.rpad(F.substring(p[6], 1, 9), 9, "0").cast("bigint"))

    trimmed = F.trim(value)
    return F.when(trimmed.rlike(pattern), let(F.split(F.regexp_replace(trimmed, pattern, to), r"\|"), instant))
