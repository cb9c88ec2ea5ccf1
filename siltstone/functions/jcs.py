"""JSON canonicalisation (RFC 8785): keys by UTF-16 units, ECMAScript numbers, minimal escapes."""

from __future__ import annotations

import json
import math


def number(x: float) -> str:
    """A double as ECMAScript prints it."""
    if math.isnan(x) or math.isinf(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, text = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, exponent = text.partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = int(exponent or 0) + (len(whole) if whole != "0" else -(len(fraction) - len(fraction.lstrip("0"))))
    digits = digits.rstrip("0")
    k = len(digits)
    if 0 < point <= 21:
        out = digits + "0" * (point - k) if k <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        e = point - 1
        out = digits[0] + ("." + digits[1:] if k > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + out


def canonical(value) -> str:
    """The canonical text of a JSON value; integers stay exact."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
