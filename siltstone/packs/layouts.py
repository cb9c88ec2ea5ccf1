"""Line layouts: how a source writes its lines, as text with fields in it.

``{name}`` is a word, ``{name:kind}`` a field of a kind, ``{name:A|B}`` one of these texts (a
single one begins with a capital); a field
without name is passed over. ``{?`` and ``?}`` enclose what may be missing. A blank stands for one
or more. A layout describes the line from its beginning, or, after ``...``, any part of it; what
ends in plain text ends the line, trailing blanks aside, unless it ends in ``...``. Everything
else stands for itself. A step may define kinds of its own by expressions.
"""

from __future__ import annotations

import re

#: Kinds of fields.
KINDS = {
    "word": r"\S+",
    "lazy": r"\S+?",
    "alpha": r"\w+",
    "upper": r"[A-Z]+",
    "name": r"[\w.-]+",
    "path": r"[\w./-]+",
    "host": r"[^\s:]+",
    "int": r"\d+",
    "signed": r"-?\d+",
    "num": r"\d+(?:\.\d+)?",
    "ipv4": r"\d{1,3}(?:\.\d{1,3}){3}",
    "address": r"[0-9A-Fa-f:.]+",
    "date": r"\d{4}-\d\d-\d\d",
    "clock": r"\d\d:\d\d:\d\d",
    "datetime": r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d",
    "span": r"[\d:]+",
    "quoted": r'[^"]*',
    "bracketed": r"[^\]]*",
    "parens": r"[^)]*",
    "clause": r"[^.]+",
    "phrase": r"[A-Za-z][A-Za-z0-9 ]*?",
    "text": r".+",
    "rest": r".*",
}
_PART = re.compile(r"\{\?|\?\}|\{(?P<name>\w*)(?::(?P<kind>[^{}]+))?\}|\s+")


def expression(layout: str, kinds: dict[str, str] | None = None) -> str:
    """The regular expression of a layout; unknown kinds are an error."""
    known = KINDS | (kinds or {})
    anywhere, open_end = layout.startswith("..."), layout.endswith("...")
    text = layout[3 if anywhere else 0 : -3 if open_end else None]
    out, at, plain_end = [] if anywhere else ["^"], 0, True
    for part in _PART.finditer(text):
        out.append(re.escape(text[at : part.start()]))
        at, found = part.end(), part.group()
        plain_end = found == "?}" or found.isspace()
        if found == "{?":
            out.append("(?:")
        elif found == "?}":
            out.append(")?")
        elif found.isspace():
            out.append(r"\s+")
        else:
            kind = part["kind"] or "word"
            if "|" in kind:
                body = "|".join(re.escape(x) for x in sorted(kind.split("|"), key=len, reverse=True))
            elif kind in known:
                body = known[kind]
            elif kind[0].isupper():
                body = re.escape(kind)
            else:
                raise ValueError(f"unknown kind {kind!r}")
            out.append(f"(?P<{part['name']}>{body})" if part["name"] else f"(?:{body})")
    if at < len(text):
        out.append(re.escape(text[at:]))
        plain_end = True
    if plain_end and not open_end and not anywhere:
        out.append(r"\s*$")
    return "".join(out)
