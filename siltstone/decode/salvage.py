"""Indicators in any text: addresses, names, links and ports, whatever the layout around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import OBSERVABLE_IDS as ID
from ..functions.values import is_email, is_hostname, is_ipv4, is_ipv6, is_mac, is_port, is_url, let

MAX_FOUND = 32
_BETWEEN = r"[\s|,;()\[\]<>\"]+"
FOUND = "array<struct<type_id:int,value:string>>"


def _one(kind: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(ID[kind]).alias("type_id"), value.alias("value")))


def _classify(token: Column) -> Column:
    candidate = F.regexp_replace(F.when(token.rlike("^[^=]*=."), F.regexp_replace(token, "^[^=]*=", "")).otherwise(token), r"^['\",;]+|['\",;]+$", "")
    none = F.array().cast(FOUND)

    def rest(c: Column) -> Column:
        host, port = F.regexp_replace(F.regexp_extract(c, "^(.+):[^:]*$", 1), r"^[\[\]]+|[\[\]]+$", ""), F.regexp_extract(c, ":([^:]*)$", 1)
        return let(F.struct(host.alias("host"), port.alias("port")), lambda hp: (
            F.when(c == "", none)
            .when(is_url(c), _one("url", c))
            .when(is_email(c), _one("email", c))
            .when(is_mac(c), _one("mac", c))
            .when(is_ipv6(c), _one("ip", c))
            .when(is_port(hp["port"]) & is_ipv4(hp["host"]), F.concat(_one("ip", hp["host"]), _one("port", hp["port"])))
            .when(is_port(hp["port"]) & is_hostname(hp["host"]), F.concat(_one("hostname", hp["host"]), _one("port", hp["port"])))
            .when(is_ipv4(c), _one("ip", c))
            .when(is_hostname(c), _one("hostname", c))
            .otherwise(none)
        ))

    return F.when(is_url(token), _one("url", token)).otherwise(let(candidate, rest))


def salvage(text: Column) -> Column:
    """Distinct ``(type_id, value)`` found in the text, ordered; the first 32 in reading order are kept."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), _BETWEEN), lambda t: t.rlike("[.:@-]"))
    return F.array_sort(F.slice(F.array_distinct(F.flatten(F.transform(tokens, _classify))), 1, MAX_FOUND))
