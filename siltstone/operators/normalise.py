"""Raw records to events: identify, decode, map, salvage, stamp.

One pass and no shuffle. Each stage is one set of columns that the optimizer keeps as computed
once; within a stage a CASE over the pack picks the expression, so a row pays only for its pack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..decode import generic_fields, generic_severity, merge_keep_first
from ..decode.salvage import salvage
from ..functions.values import present
from ..packs import compile as C
from ..packs.spec import Pack
from .entries import as_text
from .timestamps import _bound, receipt_ns, stated_instant

VERSION = "1.9.0"
_NUMBERS = ("class_uid", "activity_id", "severity_id", "time")
ENVELOPE = {"raw": "binary", "received_at": "bigint", "peer": "string", "transport": "string", "receiver_id": "string", "origin": "string", "locator": "string"}
#: Members of the envelope that an event's receipt tells, as JSON without those that are absent.
RECEIPT = ("received_at", "peer", "transport", "receiver_id", "origin")
#: What the engine itself writes into ``unmapped``.
STAMPS = ("raw_locator", "receipt", "disposition", "reason", "time_source", "salvaged_count", "syslog_severity")
_MAP = "map<string,string>"


def event_uid(received_ns: Column, *parts: Column) -> Column:
    """A time-ordered uid like UUIDv7, its random part a digest of the parts: the same input gives the same uid."""
    ms = F.lpad(F.lower(F.hex(F.coalesce(F.call_function("div", received_ns, F.lit(1_000_000)), F.lit(0)))), 12, "0")
    digest = F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(digest, 1, 3), F.lit("-8"), F.substring(digest, 4, 3), F.lit("-"), F.substring(digest, 7, 12))


def identified(raw: DataFrame, packs: list[Pack]) -> DataFrame:
    """``raw`` with its envelope completed, ``text`` and ``pack_id``."""
    have = raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast(t).alias(c) for c, t in ENVELOPE.items()], *[c for c in raw.columns if c not in ENVELOPE])
    return _bound(_bound(have, text=as_text(F.coalesce("raw", F.lit(b"")))), pack_id=C.identify(F.col("text"), packs))


def extracted(rows: DataFrame, packs: list[Pack]) -> DataFrame:
    """``rows`` with ``fields`` and ``extract_error``: the decoder chain of the pack, keys of earlier steps first."""
    none = F.struct(F.lit(None).cast(_MAP).alias("fields"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("error"))
    df = _bound(rows, _f0=F.when(F.col("pack_id").isNotNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), _b0=F.col("text"), _e0=F.lit(None).cast("string"))
    longest = max([len(p.extract) for p in packs], default=0)
    for k in range(longest):
        body = F.col(f"_b{k}")
        alike: dict[str, list[Pack]] = {}
        for pack in packs:
            if k < len(pack.extract):
                alike.setdefault(C.step_key(pack.extract[k]), []).append(pack)
        step = F
        for group in alike.values():
            step = step.when(F.col("pack_id").isin(*[p.id for p in group]), C.step_decoder(body, group[0].extract[k]))
        going = body.isNotNull() & F.col(f"_e{k}").isNull()
        hard = [p.id for p in packs if k < len(p.extract) and not p.extract[k].get("optional")]
        df = _bound(df, _s=F.when(going, step.otherwise(none)).otherwise(none), _hard=F.col("pack_id").isin(*hard) if hard else F.lit(False))
        failed = F.col("_s.error").isNotNull()
        df = _bound(
            df.withColumnRenamed(f"_f{k}", "_f"),
            **{
                f"_f{k + 1}": F.when(F.col("_s.fields").isNotNull(), merge_keep_first(F.col("_f"), F.col("_s.fields"))).otherwise(F.col("_f")),
                f"_b{k + 1}": F.when(failed, body).when(F.col("_s.fields").isNotNull(), F.col("_s.body")).otherwise(body),
                f"_e{k + 1}": F.coalesce(f"_e{k}", F.when(failed & F.col("_hard"), F.col("_s.error"))),
            },
        ).drop("_s", "_hard", "_f", f"_b{k}", f"_e{k}")
    return df.withColumnRenamed(f"_f{longest}", "fields").withColumnRenamed(f"_e{longest}", "extract_error").drop(f"_b{longest}")


def _paths(packs: list[Pack]) -> dict[str, str]:
    """Every mapped path and its type over all packs; text where packs differ."""
    kinds: dict[str, set[str]] = {}
    for pack in packs:
        for path, spec in pack.map.items():
            kinds.setdefault(path, set()).add(C.target_type(pack, spec))
    return {p: "bigint" if p in _NUMBERS else (next(iter(k)) if len(k) == 1 else "string") for p, k in kinds.items()}


def _nested(tree: dict) -> Column:
    """A struct of a tree of columns, null where all of it is."""
    fields, leaves = [], []
    for name, node in tree.items():
        column = _nested(node) if isinstance(node, dict) else node
        fields.append(column.alias(name))
        leaves.append(column.isNotNull())
    present_any = leaves[0]
    for leaf in leaves[1:]:
        present_any = present_any | leaf
    return F.when(present_any, F.struct(*fields))


def _tree(paths: dict[str, Column]) -> dict:
    out: dict = {}
    for path, column in paths.items():
        *parents, leaf = path.split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                break
        if isinstance(at, dict) and not isinstance(at.get(leaf), dict):
            at[leaf] = column
    return out


def normalise(raw: DataFrame, packs: list[Pack], year: int, inline_raw: bool = False, processed_at: int | None = None) -> DataFrame:
    """One event per record, whatever the record.

    ``raw`` needs ``raw`` (bytes); the other envelope columns may be missing. ``year`` stands
    for years that stamps leave out and ``processed_at`` for the processing clock, so that
    results repeat. Records that no pack claims, or that fail, become minimal events with
    ``disposition`` and ``reason``. Null bytes count as an empty record.
    """
    df = extracted(identified(raw, packs), packs)
    paths = _paths(packs)
    fields = F.col("fields")
    df = _bound(df, _specs=F.try_element_at(C.mapping_table(packs), F.col("pack_id")), _found=salvage(F.col("text")))
    df = _bound(df, _values=C.mapped_values(fields, F.col("_specs"), packs, year)).drop("_specs")
    df = _bound(df, _attr=F.map_from_entries(F.transform(F.filter("_values", lambda v: v["v"].isNotNull()), lambda v: F.struct(v["p"].alias("key"), v["v"].alias("value")))))
    at = lambda path: F.try_element_at("_attr", F.lit(path)).try_cast(paths.get(path, "bigint"))
    bad = (
        F.when(F.coalesce(at("class_uid"), F.lit(0)) <= 0, "class_uid is missing or not positive")
        .when(~F.coalesce(at("activity_id").between(0, 99), F.lit(False)), "activity_id is missing or out of range")
        .when(~F.coalesce(at("severity_id"), F.lit(1)).isin(0, 1, 2, 3, 4, 5, 6, 99), "severity_id is out of range")
    )
    disposition = F.when(F.col("pack_id").isNull(), "unidentified").when(F.col("extract_error").isNotNull(), "extract_failed").when(bad.isNotNull(), "normalize_failed").otherwise("parsed")
    df = _bound(df, disposition=disposition, reason=F.coalesce("extract_error", F.when(F.col("pack_id").isNotNull(), bad)))
    parsed = F.col("disposition") == "parsed"

    df = df.withColumn("_alone", F.when(~parsed, F.col("text"))).withColumn("_zone", F.lit(None).cast("string"))
    df = stated_instant(df, "_alone", "received_at", "_zone", out="_stated").drop("_alone", "_zone")
    received = receipt_ns(F.col("received_at"))
    severity = F.when(~parsed, generic_severity(F.col("text")))
    own = F.transform(F.filter("_values", lambda v: (v["o"] > 0) & v["v"].isNotNull()), lambda v: F.struct(v["p"].alias("name"), v["o"].alias("type_id"), v["v"].alias("value")))
    df = _bound(
        df,
        class_uid=F.when(parsed, at("class_uid")).otherwise(F.lit(0)),
        activity_id=F.when(parsed, at("activity_id")).otherwise(F.lit(0)),
        severity_id=F.when(parsed, F.coalesce(at("severity_id"), F.lit(1))).otherwise(severity_of(severity)),
        time=F.when(parsed, F.coalesce(at("time"), received)).otherwise(F.coalesce("_stated", received)),
        time_source=F.when(parsed, F.when(at("time").isNotNull(), "log").otherwise("receipt")).when(F.col("_stated").isNotNull(), F.when(F.col("_stated_format").isin("rfc3164", "glog", "logcat"), "log-year-assumed").otherwise("log")).otherwise("receipt"),
        _own=F.when(parsed, own).otherwise(F.array().cast("array<struct<name:string,type_id:int,value:string>>")),
        _rest=F.when(parsed, F.map_filter(fields, lambda k, v: present(v).isNotNull() & ~F.exists("_values", lambda x: x["w"].eqNullSafe(k)))),
        _generic=F.when(~parsed, generic_fields(F.col("text"))),
        event_uid=event_uid(received, F.col("locator"), F.sha2("raw", 256)),
    )
    extra = F.filter("_found", lambda f: ~F.exists("_own", lambda o: (o["type_id"] == f["type_id"]) & (o["value"] == f["value"])))
    stamps = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(k) for k in STAMPS]),
            F.array(F.col("locator"), F.nullif(F.to_json(F.struct(*RECEIPT)), F.lit("{}")), F.when(~parsed, F.col("disposition")), F.col("reason"), F.when(~parsed, F.col("time_source")), F.nullif(F.size(extra), F.lit(0)).cast("string"), severity.cast("string")),
        ),
        lambda k, v: v.isNotNull(),
    )
    df = _bound(
        df,
        category_uid=F.call_function("div", F.col("class_uid"), F.lit(1000)),
        type_uid=F.col("class_uid") * 100 + F.col("activity_id"),
        observables=F.concat("_own", F.transform(extra, lambda f: F.struct(F.lit("raw_data").alias("name"), f["type_id"].alias("type_id"), f["value"].alias("value")))),
        unmapped=merge_keep_first(stamps, F.coalesce("_rest", "_generic")),
        raw_size=F.octet_length("raw").cast("bigint"),
        raw_sha256=F.sha2("raw", 256),
    )
    about = F.create_map(*[x for p in packs for x in (F.lit(p.id), F.array(F.lit(p.vendor), F.lit(p.product), F.lit(p.log_format)))]) if packs else F.lit(None).cast("map<string,array<string>>")
    df = _bound(df, _about=F.try_element_at(about, F.col("pack_id")))
    df = _bound(df, **{c: F.get("_about", F.lit(i)) for i, c in enumerate(("vendor", "product", "log_format"))})

    leaves = {path: f"_p{i}" for i, path in enumerate(p for p in paths if p not in _NUMBERS)}
    df = _bound(df, **{c: F.when(parsed, at(path)) for path, c in leaves.items()}) if leaves else df
    body = {path: F.col(c) for path, c in leaves.items()}
    base = {
        **{c: F.col(c) for c in ("class_uid", "category_uid", "activity_id", "type_uid", "severity_id", "time")},
        "metadata.version": F.lit(VERSION), "metadata.product.name": F.col("product"), "metadata.product.vendor_name": F.col("vendor"),
        "metadata.uid": F.col("event_uid"), "metadata.log_provider": F.when(parsed, F.col("pack_id")), "metadata.log_format": F.when(parsed, F.col("log_format")),
        "metadata.logged_time": received, "metadata.processed_time": F.lit(processed_at).cast("bigint"),
        "raw_data": F.when(F.lit(inline_raw) | ~parsed, F.col("text")), "raw_data_size": F.col("raw_size"),
        "raw_data_hash.algorithm_id": F.lit(3), "raw_data_hash.value": F.col("raw_sha256"),
    }
    tree = _tree(base | {p: c for p, c in body.items() if not p.startswith("unmapped.")})
    extras = {p[9:]: c for p, c in body.items() if p.startswith("unmapped.")}
    unmapped = F.col("unmapped")
    if extras:
        unmapped = F.map_filter(merge_keep_first(F.map_from_arrays(F.array(*[F.lit(k) for k in extras]), F.array(*[c.cast("string") for c in extras.values()])), unmapped), lambda k, v: v.isNotNull())
    columns = [_nested({k: v}).getField(k).alias(k) if isinstance(v, dict) else v.alias(k) for k, v in tree.items()]
    event = F.struct(*columns, F.when(F.size("observables") > 0, F.col("observables")).alias("observables"), F.when(F.size(unmapped) > 0, unmapped).alias("unmapped"))
    out = _bound(df, event=event)
    return out.select(
        "event_uid", "locator", "received_at", "peer", "transport", "receiver_id", "origin", "text", "pack_id", "vendor", "product", "disposition", "reason", "fields",
        "class_uid", "category_uid", "activity_id", "type_uid", "severity_id", "time", "time_source", "observables", F.col("event.unmapped").alias("unmapped"), "raw_size", "raw_sha256",
        "event", F.to_json("event").alias("event_json"), *[c for c in raw.columns if c not in ENVELOPE],
    )


def severity_of(syslog: Column) -> Column:
    """Syslog severity to event severity; unknown is informational."""
    return F.when(syslog == 0, 6).when(syslog.isin(1, 2), 5).when(syslog == 3, 4).when(syslog == 4, 3).when(syslog == 5, 2).otherwise(1).cast("bigint")


def dead_letters(events: DataFrame) -> DataFrame:
    """The records that are not parsed, with their text, disposition, pack and locator."""
    lossy = F.col("text").contains("�")
    return events.where(F.col("disposition") != "parsed").select(
        F.col("text").alias("raw_text"), F.when(lossy, "lossy-utf-8").otherwise("utf-8").alias("raw_encoding"), "disposition", "reason", F.col("pack_id").alias("pack"), "locator", "received_at"
    )


def stats(events: DataFrame) -> DataFrame:
    """Received, by disposition, bytes, and the share parsed, of all events; one row also for none."""
    is_ = lambda d: F.count_if(F.col("disposition") == d)
    searchable = (F.col("disposition") == "unidentified") & ((F.size("observables") > 0) | (F.size(F.map_filter("unmapped", lambda k, v: ~k.isin(*STAMPS))) > 0))
    return events.agg(
        F.count(F.lit(1)).alias("received"), is_("parsed").alias("parsed"), is_("unidentified").alias("unidentified"), is_("extract_failed").alias("extract_failed"),
        is_("normalize_failed").alias("normalize_failed"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("bytes_in"), F.count_if(searchable).alias("searchable_unidentified"),
        F.coalesce(F.try_divide(is_("parsed"), F.count(F.lit(1))), F.lit(0.0)).alias("coverage"),
    )


def by_pack(events: DataFrame) -> DataFrame:
    return events.where(F.col("disposition") == "parsed").groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"))
