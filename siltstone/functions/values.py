"""Scalar functions on extracted values, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as absent, and the words of truth.
EMPTY_MARKERS = ("", "-", "n/a", "null", "none", "unknown")
TRUE_WORDS = ("true", "yes", "y", "1", "on", "enable", "enabled")
FALSE_WORDS = ("false", "no", "n", "0", "off", "disable", "disabled")

#: Type ids of observables.
OBSERVABLE_IDS = {"hostname": 1, "ip": 2, "mac": 3, "user": 4, "email": 5, "url": 6, "domain": 8, "port": 11, "fingerprint": 30}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
HOSTNAME = r"^(?=.{4,253}$)(?!\.)(?!.*\.\.)[A-Za-z0-9._-]*\.[A-Za-z]{2,}$"
EMAIL = r"^[A-Za-z0-9._+-]{1,64}@(?=[^@]{4,253}$)(?!\.)(?!.*\.\.)[A-Za-z0-9._-]*\.[A-Za-z]{2,}$"
MAC = r"^(?:[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5})$"


def let(value: Column, then) -> Column:
    """``then`` of the value, which is computed once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def present(value: Column) -> Column:
    """The value, or null where it is an empty marker."""
    return F.when(F.lower(F.trim(value)).isin(*EMPTY_MARKERS), None).otherwise(value)


def as_int(value: Column) -> Column:
    return F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("bigint"))


def as_float(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def as_bool(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def is_url(s: Column) -> Column:
    return s.startswith("http://") | s.startswith("https://") | s.startswith("ftp://")


def is_ipv4(s: Column) -> Column:
    return s.rlike(IPV4)


def is_ipv6(s: Column) -> Column:
    """At least two colons, hex digits, and ``::`` or a letter."""
    return s.rlike(r"^[0-9A-Fa-f:.]{3,}$") & s.rlike(":.*:") & (s.contains("::") | s.rlike("[A-Fa-f]"))


def is_mac(s: Column) -> Column:
    return s.rlike(MAC)


def is_port(s: Column) -> Column:
    return s.rlike(r"^\d{1,5}$") & s.try_cast("int").between(1, 65535)


def is_hostname(s: Column) -> Column:
    return s.rlike(HOSTNAME)


def is_email(s: Column) -> Column:
    return s.rlike(EMAIL)


def is_private(ip: Column) -> Column:
    """1 for private, loopback, link-local and unspecified addresses, 0 for others and unreadable ones, -1 for none."""
    low = F.lower(ip)
    v4 = is_ipv4(ip) & (
        ip.startswith("10.") | ip.startswith("127.") | ip.startswith("192.168.") | ip.startswith("169.254.") | ip.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\.") | (ip == "0.0.0.0")
    )
    v6 = low.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$") & (
        low.isin("::1", "::") | low.rlike(r"^(?:0+:){7}0*[01]$") | low.rlike(r"^f[cd][0-9a-f]{2}:") | low.rlike(r"^fe[89ab][0-9a-f]:")
    )
    return F.when(F.coalesce(ip, F.lit("")) == "", -1).when(v4 | v6, 1).otherwise(0).cast("bigint")


def locator(segment: Column, offset: Column, length: Column, scheme: str = "vault") -> Column:
    """``<scheme>:raw:<segment>:<offset>:<length>`` in sortable hex."""
    return F.format_string(f"{scheme}:raw:%016x:%016x:%08x", segment, offset, length)


_LOCATOR = r"^[a-z]+:raw:([0-9a-f]{16}):([0-9a-f]{16}):([0-9a-f]{8})$"


def parse_locator(text: Column) -> Column:
    """``struct<segment, offset, len>`` of a locator of any scheme, null for any other text."""
    part = lambda i: F.conv(F.regexp_extract(text, _LOCATOR, i), 16, 10).try_cast("bigint")
    return F.when(text.rlike(_LOCATOR), F.struct(part(1).alias("segment"), part(2).alias("offset"), part(3).alias("len")))


def unescape(value: Column, named: bool = True) -> Column:
    """Backslash escapes resolved: n, r and t (if ``named``), any other character itself."""
    def resolve(v: Column) -> Column:
        held = F.replace(v, F.lit("\\\\"), F.lit("\x00"))
        if named:
            for letter, char in (("n", "\n"), ("r", "\r"), ("t", "\t")):
                held = F.replace(held, F.lit("\\" + letter), F.lit(char))
        return F.when(v.contains("\\"), F.replace(F.regexp_replace(held, r"(?s)\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))).otherwise(v)

    return let(value, resolve)


def template(text: Column) -> Column:
    """Words masked: ``<ip>``, ``<number>``, ``<hex>``, ``key=<value>``, ``<value>`` for words with digits; lower case."""
    return F.array_join(
        F.transform(
            F.filter(F.split(text, r"\s+"), lambda t: t != ""),
            lambda t: F.when(is_ipv4(F.regexp_replace(t, r"^[^\w]+|[^\w]+$", "")), "<ip>")
            .when(t.rlike(r"^[+-]?\d+(?:\.\d+)?[,;:]?$"), "<number>")
            .when((F.length(t) > 24) & t.rlike(r"^[0-9A-Fa-f]+$"), "<hex>")
            .when(t.rlike(r"^[^=]+=."), F.concat(F.regexp_extract(t, r"^([^=]+)=", 1), F.lit("=<value>")))
            .when(t.rlike(r"\d"), "<value>")
            .otherwise(F.lower(t)),
        ),
        " ",
    )


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a, the public function, for short identifiers on the driver."""
    value = 0xCBF29CE484222325
    for byte in data:
        value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    return value


