"""Nested records to related flat tables by adjacency-table shredding.

Every JSON value below a chosen member becomes a row ``(doc_key, node, above, path, ordinal,
kind, scalar)``: its number in the document, the numbers of the nodes above it (the parent
last), the labels from the member to it. Object nodes are then joined with the scalars below
them and pivoted into entity tables. The join is one aggregation keyed by the object's node:
the object contributes its own row, each scalar contributes to the object above it, so a
single shuffle on ``(doc_key, node)`` yields the entity rows and repeated documents collapse,
most of them before it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "doc_key binary, owner string, node bigint, above array<bigint>, path array<string>, ordinal int, top int, kind string, scalar string"


#: The step of a path into a list; a member that is really called so has a backslash before it.
LIST_ITEM = "[]"
#: Documents shredded at once.
SLICE = 250


class _Written(str):
    """A number kept as the text it was written with."""


_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|NaN|-?Infinity)|(true|false|null))')


def _parse_deep(text: str):
    """JSON nested too deep for the interpreter's stack, by a stack of its own: the same values and errors as ``json.loads``."""
    literals = {"true": True, "false": False, "null": None}
    root: list = []
    open_, keys, at = [root], [None], 0  # containers that are not closed, and the key that waits in each
    expect = "value"
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError("no JSON")
        at = found.end()
        mark, string, number, literal = found.groups()
        here = open_[-1]
        if mark and mark in "}]" and expect in ("after", "first") and len(open_) > 1 and isinstance(here, dict if mark == "}" else list):
            open_.pop(), keys.pop()
            expect = "after"
            continue
        if mark == "," and expect == "after" and len(open_) > 1:
            expect = "key" if isinstance(here, dict) else "value"
            continue
        if mark == ":" and expect == "colon":
            expect = "value"
            continue
        if string and isinstance(here, dict) and expect in ("key", "first"):
            keys[-1], expect = json.loads(string), "colon"
            continue
        if expect not in ("value", "first") or isinstance(here, dict) and expect == "first" or mark and mark not in "{[" or here is root and root:
            raise ValueError("no JSON")
        value = {} if mark == "{" else [] if mark == "[" else json.loads(string) if string else _Written(number) if number else literals[literal]
        if isinstance(here, dict):
            here[keys[-1]] = value
        else:
            here.append(value)
        if mark:
            open_.append(value), keys.append(None)
        expect = "first" if mark else "after"
    if len(open_) > 1 or not root:
        raise ValueError("no JSON")
    return root[0]


def _loads(text: str):
    try:
        return json.loads(text, parse_int=_Written, parse_float=_Written, parse_constant=_Written)
    except RecursionError:
        return _parse_deep(text)


def _load(text: str):
    """JSON with numbers as written; a string that itself holds a document is opened."""
    value = _loads(text)
    if isinstance(value, str) and not isinstance(value, _Written) and value.lstrip()[:1] in ("{", "["):
        value = _loads(value)
    return value


def _scalar(value) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if value is True or value is False:
        return "boolean", "true" if value else "false"
    if isinstance(value, _Written):
        return "number", str(value)
    return "string", value.encode("utf-8", "replace").decode("utf-8")


def walk(value, label: str, lists: frozenset[str], wanted: frozenset[tuple[str, ...]] | None = None):
    """Yield the adjacency rows ``(node, above, path, ordinal, top, kind, scalar)`` of ``value`` and all below it, parents first.

    Nodes are numbered within the document in the order of the walk; nothing is above the
    first. ``path`` holds the labels from the first node on, ``[]`` for an element of a list; a
    label is one element whatever characters it has. ``top`` is the position in the first
    list passed. With ``wanted`` only nodes of these paths have a row; what can not lead to
    one is not walked. The walk keeps its own stack, so depth is bounded by memory only.
    """
    leads = None if wanted is None else {p[:n] for p in wanted for n in range(1, len(p) + 1)}
    stack, number = [(value, (), (label,), 0, None, label)], 0
    while stack:
        value, above, path, ordinal, top, label = stack.pop()
        if leads is not None and path not in leads:
            continue
        node, number = number, number + 1
        if label in lists and isinstance(value, dict):
            value = [value]
        if isinstance(value, dict):
            kind, scalar = "object", None
            stack.extend((v, (*above, node), (*path, "\\[]" if k == LIST_ITEM else k), 0, top, k) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            kind, scalar = "array", None
            stack.extend((v, (*above, node), (*path, LIST_ITEM), i, i if top is None else top, "") for i, v in reversed(list(enumerate(value))))
        else:
            kind, scalar = _scalar(value)
        if wanted is None or path in wanted:
            yield node, above, path, ordinal, top, kind, scalar


def _get(document, member: str):
    if not isinstance(document, dict):
        return None
    if member in document:
        return document[member]
    return None


def shred(df: DataFrame, json_col: str, owner_col: str, member: str, lists: Iterable[str] = (), wanted: Iterable[tuple[str, ...]] | None = None) -> DataFrame:
    """The adjacency table of ``member`` in each document of ``json_col``.

    ``lists`` names members that are lists; an object in place of one is a list of one. With
    ``wanted`` only nodes of these paths (which begin with ``member``) have a row. Null,
    empty or unparsable documents and documents without the member give no rows; a repeated
    document gives the same ``doc_key`` and nodes. Documents may be nested to any depth.
    Numbers keep the text they were written with. Other columns of ``df`` are ignored,
    whatever their names.
    """
    lists, wanted = frozenset(lists), None if wanted is None else frozenset(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split()[0] for f in NODE_SCHEMA.split(",")]
        types = [pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for whole in batches:
            # in slices: a document becomes many rows, and a batch of them would be held several times over
            for batch in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                out: list[list] = [[] for _ in names]
                for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not text:
                        continue
                    try:
                        value = _get(_load(text), member)
                    except ValueError:
                        continue
                    if value is None:
                        continue
                    key = hashlib.blake2b(f"{owner}\x00{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    for found in walk(value, member, lists, wanted):
                        for column, x in zip(out, (key, owner, *found)):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    narrow = df.select(F.col(owner_col).alias("owner"), F.col(json_col).alias("doc"))
    return narrow.mapInArrow(rows, NODE_SCHEMA)


#: Per kind of object its path and, per column, the path from the object to the scalar that fills it.
Entities = dict[str, tuple[tuple[str, ...], dict[str, tuple[str, ...]]]]


def paths_of(kinds: Entities) -> list[tuple[str, ...]]:
    """The paths that ``entities`` needs of ``kinds``."""
    return [p for path, fields in kinds.values() for p in (path, *[(*path, *f) for f in fields.values()])]


def _literal(path: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in path])


def entities(nodes: DataFrame, kinds: Entities) -> DataFrame:
    """The object nodes of ``kinds`` joined with the scalars below them, pivoted.

    One row per object: ``doc_key, owner, node, above, kind, ordinal, top`` and one string
    column per column named, null where the scalar is absent, null or no scalar.
    """
    is_object = F.col("kind") == "object"
    of_object = [(F.col("path") == _literal(path), kind) for kind, (path, _) in kinds.items()]
    of_scalar = [(F.col("path") == _literal((*path, *f)), column, len(f)) for path, fields in kinds.values() for column, f in fields.items()]
    kind = F.coalesce(*[F.when(is_object & hit, F.lit(k)) for hit, k in of_object])
    is_scalar = ~F.col("kind").isin("object", "array")
    column = F.coalesce(*[F.when(is_scalar & hit, F.lit(c)) for hit, c, _ in of_scalar], F.lit(None).cast("string"))
    up = F.coalesce(*[F.when(hit, F.lit(-n)) for hit, _, n in of_scalar], F.lit(-1))
    names = list(dict.fromkeys(c for _, fields in kinds.values() for c in fields))
    placed = nodes.select("doc_key", "owner", "node", "above", "ordinal", "top", "scalar", kind.alias("kind"), column.alias("column"), up.alias("up")).where(F.col("kind").isNotNull() | F.col("column").isNotNull())
    own = lambda name: F.max(F.when(F.col("kind").isNotNull(), F.col(name))).alias(name)
    return (
        placed.groupBy("doc_key", "owner", F.when(F.col("kind").isNotNull(), F.col("node")).otherwise(F.try_element_at("above", "up")).alias("entity"))
        .agg(*[own(c) for c in ("above", "kind", "ordinal", "top")], *[F.max(F.when(F.col("column") == c, F.col("scalar"))).alias(c) for c in names])
        .where(F.col("kind").isNotNull())
        .withColumnRenamed("entity", "node")
    )


A = ("attestation_list", LIST_ITEM)


def _same(*names: str) -> dict[str, tuple[str, ...]]:
    return {n: (n,) for n in names}


_FINGERPRINT = _same("algorithm_id", "algorithm", "encoding_id", "serialization_id", "value")
ATTESTATION: Entities = {
    "attestation": (A, _same("uid", "authority_uid", "chain_uid")),
    "prev_event": ((*A, "prev_event"), _same("uid", "type_uid")),
    "prev_fingerprint": ((*A, "prev_event", "fingerprint"), _FINGERPRINT),
    "fingerprint": ((*A, "fingerprint"), _FINGERPRINT),
    "signature": ((*A, "signatures", LIST_ITEM), {**_same("algorithm_id", "algorithm", "created_time", "serialization_id", "developer_uid"), "digest_value": ("digest", "value")}),
}
#: The one value of each object that the table of all children shows.
CHILDREN: Entities = {
    "prev_event": (ATTESTATION["prev_event"][0], {"child_value": ("uid",)}),
    "prev_fingerprint": (ATTESTATION["prev_fingerprint"][0], {"child_value": ("value",)}),
    "fingerprint": (ATTESTATION["fingerprint"][0], {"child_value": ("value",)}),
    "signature": (ATTESTATION["signature"][0], {"child_value": ("digest", "value")}),
}


def attestation_entities(recent: DataFrame, kinds: Entities = ATTESTATION) -> DataFrame:
    """The objects of ``kinds`` in the attestations of ``recent_events``, one row each.

    Columns: doc_key, event_uid, att_no, kind, child_no and the columns of ``kinds``; null
    where an object has no such scalar.
    """
    nodes = shred(recent, "event_json", "event_uid", "attestation_list", ("attestation_list", "signatures"), paths_of(kinds))
    found = entities(nodes, kinds)
    names = [c for c in found.columns if c not in ("doc_key", "owner", "node", "above", "kind", "ordinal", "top")]
    child_no = F.when(F.col("kind") == "signature", F.col("ordinal")).otherwise(F.lit(0)).alias("child_no")
    return found.select("doc_key", F.col("owner").alias("event_uid"), F.col("top").alias("att_no"), "kind", child_no, *names)


def attestation_children(recent: DataFrame) -> DataFrame:
    """``(event_uid, att_no, kind, child_no, child_value)``, distinct: the objects found in attestations."""
    value = F.when(F.col("kind") == "signature", F.coalesce("child_value", F.lit(""))).otherwise(F.col("child_value"))
    return attestation_entities(recent, CHILDREN).select("event_uid", "att_no", "kind", "child_no", value.alias("child_value")).distinct()
