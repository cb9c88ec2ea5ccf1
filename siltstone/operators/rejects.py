"""Rows that fail to parse, separated with their reason while the valid ones come out typed.

Records of one source are checked in Arrow batches: strict quoting by one linear-time
expression, wrong column counts by the CSV reader's invalid-row callback, then every column
is read as strings and cast as a vector; the first cell that does not fit its kind labels
the row. No shuffle: rows are judged where they are read.
"""

from __future__ import annotations

import io
import ipaddress
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About so many layout rows are shipped with one task closure; a larger table takes several passes, each over the rows of its packs.
LAYOUT_ROWS = 50_000
_LF, _CR = "\x1e", "\x1f"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_STAMP = r"^[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"

RESULT_SCHEMA = (
    "locator string, pack string, reason string, bad_col int, "
    "fields array<struct<col_no:int,col_name:string,kind:string,text:string,whole:bigint,real:double,stamp_ns:bigint>>"
)


def _quoting(delim: str, quote: str | None) -> str:
    """The expression of a soundly quoted record."""
    if not quote:
        return r"(?s)\A.*\z"
    q, d = (pc_escape(c) for c in (quote, delim))
    one = f"(?:{q}(?:[^{q}]|{q}{q})*{q}|[^{q}{d}]*)"
    return rf"(?s)\A{one}(?:{d}{one})*\z"


def pc_escape(char: str) -> str:
    return "\\" + char if not char.isalnum() and char not in "\t\n\r" else {"\t": r"\t", "\n": r"\n", "\r": r"\r"}.get(char, char)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    y = np.where(m <= 2, y - 1, y)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _stamps(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    shaped = pc.match_substring_regex(column, _STAMP).to_numpy(zero_copy_only=False)
    part = lambda a, b: pc.cast(pc.if_else(pa.array(shaped), pc.utf8_slice_codeunits(column, a, b), "1"), pa.int64()).to_numpy()
    y, mo, d, h, mi, s = (part(a, b) for a, b in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    ok = shaped & (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (h < 24) & (mi < 60) & (s < 60)
    mo_ok = np.clip(mo, 1, 12)
    nxt = _days(np.where(mo_ok == 12, y + 1, y), np.where(mo_ok == 12, 1, mo_ok + 1), np.ones_like(y))
    ok &= d <= nxt - _days(y, mo_ok, np.ones_like(y))
    seconds = _days(y, mo_ok, d) * 86400 + h * 3600 + mi * 60 + s
    return ok, seconds * 1_000_000_000


def _is_ip(text: str) -> bool:
    if "%" in text:
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def _digits(column: pa.Array, top: str) -> np.ndarray:
    """Whether each value is digits of at most ``top``."""
    digits = pc.match_substring_regex(column, r"^[0-9]+$")
    bare = pc.utf8_ltrim(column, characters="0")
    n = pc.utf8_length(bare)
    fits = pc.or_(pc.less(n, len(top)), pc.and_(pc.equal(n, len(top)), pc.less_equal(bare, top)))
    return pc.and_(digits, fits).to_numpy(zero_copy_only=False)


def check_column(column: pa.Array, kind: str, optional: bool) -> tuple[np.ndarray, dict[str, list]]:
    """Which cells fit ``kind``, and their typed values (None where absent or unfit)."""
    n = len(column)
    absent = pc.is_in(column, pa.array(["", "-"])).to_numpy(zero_copy_only=False) if optional else np.zeros(n, bool)
    typed: dict[str, list] = {}

    def keep(name: str, values: list, ok: np.ndarray) -> None:
        typed[name] = [v if k else None for v, k in zip(values, ok & ~absent)]

    if kind == "ip":
        ok = pc.match_substring_regex(column, _IPV4).to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(~ok & pc.match_substring(column, ":").to_numpy(zero_copy_only=False)):
            ok[i] = _is_ip(column[i].as_py())
    elif kind in ("port", "count"):
        ok = _digits(column, "65535" if kind == "port" else "9223372036854775807")
        keep("whole", pc.cast(pc.if_else(pa.array(ok), column, "0"), pa.int64()).to_pylist(), ok)
    elif kind == "epoch":
        ok = pc.match_substring_regex(column, r"^[0-9]+(?:\.[0-9]+)?$").to_numpy(zero_copy_only=False)
        keep("real", pc.cast(pc.if_else(pa.array(ok), column, "0"), pa.float64()).to_pylist(), ok)
    elif kind == "stamp":
        ok, ns = _stamps(column)
        keep("stamp_ns", ns.tolist(), ok)
    elif kind == "word":
        ok = pc.and_(pc.greater(pc.utf8_length(column), 0), pc.invert(pc.match_substring_regex(column, _SPACE))).to_numpy(zero_copy_only=False)
    elif kind.startswith("enum:"):
        ok = pc.is_in(column, pa.array(kind[5:].split("|"))).to_numpy(zero_copy_only=False)
    else:
        ok = np.ones(n, bool)
    return ok | absent, typed


def _split(texts: list[str], delim: str, quote: str | None, n_cols: int) -> tuple[list[pa.Array], np.ndarray]:
    """Columns of the rows with ``n_cols`` fields, and which rows those are.

    Line breaks inside fields are carried through the reader as control characters, so that
    one line is one record; records that hold those characters themselves are read alone.
    """
    ok = np.ones(len(texts), bool)
    if n_cols > 1:
        ok[[i for i, t in enumerate(texts) if t == ""]] = False
    odd = {i for i, t in enumerate(texts) if ok[i] and (_LF in t or _CR in t)}
    plain = [i for i in range(len(texts)) if ok[i] and i not in odd]
    names = [f"c{i}" for i in range(n_cols)]

    def read(which: list[int], coded: bool) -> list[pa.Array]:
        lines = [texts[i].replace("\n", _LF).replace("\r", _CR) if coded else texts[i] for i in which]
        data = ("\n".join(lines) + "\n").encode("utf-8", "replace")
        wrong: list[int] = []

        def invalid(row) -> str:
            wrong.append(row.number - 1 if row.number else 0)
            return "skip"

        got = pacsv.read_csv(
            io.BytesIO(data),
            read_options=pacsv.ReadOptions(use_threads=False, column_names=names, block_size=len(data) + 16),
            parse_options=pacsv.ParseOptions(delimiter=delim, quote_char=quote or False, double_quote=bool(quote), escape_char=False, newlines_in_values=not coded, ignore_empty_lines=False, invalid_row_handler=invalid),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
        for w in wrong:
            ok[which[w]] = False
        columns = [got.column(k).combine_chunks() for k in range(n_cols)]
        if coded:
            columns = [pc.replace_substring(pc.replace_substring(c, _LF, "\n"), _CR, "\r") for c in columns]
        return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]

    order: list[int] = []
    parts: list[list[pa.Array]] = []
    if plain:
        parts.append(read(plain, True))
        order += [i for i in plain if ok[i]]
    for i in sorted(odd):
        parts.append(read([i], False))
        order += [i] if ok[i] else []
    columns = [pa.concat_arrays([p[k].cast(pa.string()) for p in parts]) if parts else pa.array([], pa.string()) for k in range(n_cols)]
    back = pa.array(np.argsort(np.array(order, dtype=np.int64), kind="stable"))
    return [c.take(back) for c in columns], ok


def judge(texts: list[str | None], layout: dict) -> tuple[list[str | None], list[int | None], list[list | None]]:
    """Reason (None: valid), first bad column and typed fields of each record of one layout."""
    bare = ["" if t is None else t[:-2] if t.endswith("\r\n") else t[:-1] if t.endswith("\n") else t for t in texts]
    columns, delim, quote = layout["columns"], layout["delim"], layout["quote"]
    sound = pc.match_substring_regex(pa.array(bare, pa.string()), _quoting(delim, quote)).to_numpy(zero_copy_only=False)
    reasons: list[str | None] = [None if s else "quoting" for s in sound]
    bad: list[int | None] = [None] * len(texts)
    fields: list[list | None] = [None] * len(texts)
    which = np.flatnonzero(sound)
    if not len(which):
        return reasons, bad, fields
    cells, ok = _split([bare[i] for i in which], delim, quote, len(columns))
    for i in which[~ok]:
        reasons[i] = "columns"
    which = which[ok]
    first = np.full(len(which), -1)
    typed = []
    for k, (column, (_, kind, optional)) in enumerate(zip(cells, columns)):
        fit, values = check_column(column, kind, optional)
        typed.append((column.to_pylist(), values))
        first = np.where((first < 0) & ~fit, k, first)
    for j, i in enumerate(which):
        if first[j] >= 0:
            reasons[i], bad[i] = "value", int(first[j])
        else:
            fields[i] = [
                {"col_no": k, "col_name": name, "kind": kind, "text": typed[k][0][j]} | {x: typed[k][1].get(x, [None] * len(which))[j] for x in ("whole", "real", "stamp_ns")}
                for k, (name, kind, _) in enumerate(columns)
            ]
    return reasons, bad, fields


def load_layouts(layouts: DataFrame) -> dict[str, dict]:
    """Layouts by pack, in the driver; see ``sort_rows`` on the size."""
    rows = layouts.select("pack_id", "delim", "quote_char", "col_no", "col_name", "kind", "is_optional").collect()
    out: dict[str, dict] = {}
    for r in sorted((r for r in rows if r.pack_id is not None and r.col_no is not None), key=lambda r: (r.pack_id, r.col_no)):
        one = out.setdefault(r.pack_id, {"delim": r.delim or ",", "quote": r.quote_char or None, "columns": []})
        one["columns"].append((r.col_name, r.kind or "text", bool(r.is_optional)))
    return out


_ARROW = pa.schema([
    ("locator", pa.string()), ("pack", pa.string()), ("reason", pa.string()), ("bad_col", pa.int32()),
    ("fields", pa.list_(pa.struct([("col_no", pa.int32()), ("col_name", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("whole", pa.int64()), ("real", pa.float64()), ("stamp_ns", pa.int64())]))),
])


def sort_rows(letters: DataFrame, layouts: DataFrame, layout_rows: int = LAYOUT_ROWS) -> DataFrame:
    """Every dead letter with a pack: its reason (null: valid) and its typed fields.

    A null text counts as an empty record. A pack without a layout has reason ``layout``.
    Repeated rows stay repeated. Columns other than locator, pack and raw_text are ignored.
    Layouts beyond ``layout_rows`` are taken in several passes by pack.
    """
    parts = -(-layouts.count() // layout_rows) or 1
    of_part = lambda pack, k: F.pmod(F.xxhash64(pack), F.lit(parts)) == k
    rows = letters.where(F.col("pack").isNotNull()).select("locator", "pack", "raw_text")
    judged = [_judge_all(rows.where(of_part("pack", k)), load_layouts(layouts.where(of_part("pack_id", k)))) for k in range(parts)] if parts > 1 else [_judge_all(rows, load_layouts(layouts))]
    return reduce(DataFrame.unionByName, judged)


def _judge_all(rows: DataFrame, known: dict[str, dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            locators, packs, texts = (batch.column(i).to_pylist() for i in range(3))
            reasons: list[str | None] = ["layout"] * len(packs)
            bad: list[int | None] = [None] * len(packs)
            fields: list[list | None] = [None] * len(packs)
            by: dict[str, list[int]] = {}
            for i, p in enumerate(packs):
                by.setdefault(p, []).append(i)
            for p, at in by.items():
                if p in known:
                    for i, r, b, f in zip(at, *judge([texts[i] for i in at], known[p])):
                        reasons[i], bad[i], fields[i] = r, b, f
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((locators, packs, reasons, bad, fields), _ARROW.types)], schema=_ARROW)

    return rows.mapInArrow(run, RESULT_SCHEMA)


#: The sound dispositions of the event contract.
SOUND_DISPOSITIONS = ("parsed", "unidentified", "extract_failed", "normalize_failed")


def unsound_dispositions(recent: DataFrame) -> DataFrame:
    """Locators whose disposition is no sound one, or whose pack is null other than exactly for ``unidentified``."""
    known = F.coalesce(F.col("disposition").isin(*SOUND_DISPOSITIONS), F.lit(False))
    paired = F.col("pack").isNull() == (F.coalesce("disposition", F.lit("")) == "unidentified")
    return recent.where(~(known & paired)).select("locator", F.lit("disposition").alias("reason"))


def rejects(letters: DataFrame, recent: DataFrame, layouts: DataFrame) -> DataFrame:
    """``(locator, reason)``, distinct: quoting, columns, value, disposition, or layout where a pack has none to be read by.

    Every dead letter with a pack is either here or, typed, among the rows of ``sort_rows`` without a reason.
    """
    bad = sort_rows(letters, layouts).where(F.col("reason").isNotNull()).select("locator", "reason")
    return bad.unionByName(unsound_dispositions(recent)).distinct()
