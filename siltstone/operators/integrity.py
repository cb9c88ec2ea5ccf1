"""Evidence: hash chains, their verification in parallel, Merkle logs, proofs and checkpoints.

Attesting is sequential within a chain and parallel over chains. Verification needs no order
of work: each event's hash is checked where it lies, each link against its neighbour by a
window over blocks of the chain, so that a chain of any length is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ed25519
from ..functions.jcs import canonical

BLOCK = 1 << 16

# --- fingerprints ---------------------------------------------------------------------------------


def fingerprint(value: str, algorithm: str = "SHA-256", jcs: bool = True) -> dict:
    if algorithm != "SHA-256":
        raise NotImplementedError(f"{algorithm}: only SHA-256 is available here")
    return {"algorithm_id": 3, "encoding_id": 1, "serialization_id": 2 if jcs else 1, "value": value}


def _without_fingerprint(event: dict) -> dict:
    entries = event.get("attestation_list") or []
    return event | {"attestation_list": [{k: v for k, v in a.items() if k != "fingerprint"} for a in entries]}


def event_digest(event: dict) -> str:
    """SHA-256 of the canonical event, its attestations without fingerprint."""
    return hashlib.sha256(canonical(_without_fingerprint(event)).encode("utf-8", "surrogatepass")).hexdigest()


def attest_one(event: dict, chain: str, authority: str, previous: dict | None) -> dict:
    """``event`` with its attestation: the previous event's uid, type and fingerprint, and its own fingerprint."""
    metadata = event.setdefault("metadata", {})
    profiles = metadata.setdefault("profiles", [])
    if "record_integrity" not in profiles:
        profiles.append("record_integrity")
    link = {"authority_uid": authority, "chain_uid": chain} | ({"prev_event": previous} if previous else {})
    event["attestation_list"] = [link]
    link["fingerprint"] = fingerprint(event_digest(event))
    return event


ATTESTED = "chain_uid string, seq bigint, event_uid string, event_json string, fingerprint string"


def attest(events: DataFrame, authority: str = "authority", heads: dict[str, dict] | None = None) -> DataFrame:
    """Events ``(chain_uid, seq, event_uid, event_json)`` hash-chained in order of seq within each chain.

    ``heads`` resumes chains: chain to ``{uid, type_uid, fingerprint}`` of its last event. A
    chain is sequential by nature and streamed through one task batch by batch, never held as
    a whole. Null chains and unparsable events are left out.
    """
    heads = heads or {}
    ordered = (
        events.where(F.col("chain_uid").isNotNull() & F.try_parse_json("event_json").isNotNull())
        .select("chain_uid", "seq", "event_uid", "event_json")
        .repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chain_uid")
        .sortWithinPartitions("chain_uid", "seq")
    )
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = [c.split()[0] for c in ATTESTED.split(", ")]

    def run(batches):
        last: dict[str, dict | None] = dict(heads)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in batch.to_pylist():
                chain = row["chain_uid"]
                event = attest_one(json.loads(row["event_json"]), chain, authority, last.get(chain))
                print_ = event["attestation_list"][0]["fingerprint"]
                last[chain] = {k: v for k, v in (("uid", row["event_uid"]), ("type_uid", event.get("type_uid")), ("fingerprint", print_)) if v is not None}
                for column, x in zip(out, (chain, row["seq"], row["event_uid"], json.dumps(event, ensure_ascii=False, separators=(",", ":")), print_["value"])):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return ordered.mapInArrow(run, ATTESTED)


def _links(attested: DataFrame) -> DataFrame:
    """Per event: whether its hash holds, its fingerprint, chain, authority and what it says of its predecessor."""
    schema = "chain_uid string, seq bigint, event_uid string, own_ok boolean, said_chain string, authority string, own string, type_uid bigint, prev_uid string, prev_type bigint, prev string"
    names = [c.strip().split()[0] for c in schema.split(",")]
    types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in batch.to_pylist():
                try:
                    event = json.loads(row["event_json"])
                    a = event["attestation_list"][0]
                    own = a["fingerprint"]["value"]
                    previous = a.get("prev_event") or {}
                    as_int = lambda x: x if isinstance(x, int) else None
                    got = (event_digest(event) == own, a.get("chain_uid"), a.get("authority_uid"), own, as_int(event.get("type_uid")), previous.get("uid"), as_int(previous.get("type_uid")), (previous.get("fingerprint") or {}).get("value"))
                except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                    got = (False, None, None, None, None, None, None, None)
                for column, x in zip(out, (row["chain_uid"], row["seq"], row["event_uid"], *got)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return attested.select("chain_uid", "seq", "event_uid", "event_json").mapInArrow(run, schema)


def verify_events(attested: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(chain_uid, seq, event_uid, own_ok, link_ok)``: each event's own hash and its link to its predecessor.

    The first event of a chain must name no predecessor. The neighbour comes from a window
    within blocks of seq; the first of a block looks at the last of the block before it.
    """
    links = _links(attested).withColumn("_block", F.floor(F.col("seq") / block))
    said = F.struct("event_uid", "type_uid", "own", "authority")
    within = W.partitionBy("chain_uid", "_block").orderBy("seq")
    ends = links.groupBy("chain_uid", "_block").agg(F.max_by(said, "seq").alias("_end"))
    carried = ends.select("chain_uid", "_block", F.lag("_end").over(W.partitionBy("chain_uid").orderBy("_block")).alias("_carried"))
    with_before = links.withColumn("_lag", F.lag(said).over(within)).join(carried, ["chain_uid", "_block"], "left").withColumn("_before", F.coalesce("_lag", "_carried"))
    same = (
        F.col("prev_uid").eqNullSafe(F.col("_before.event_uid"))
        & F.col("prev").eqNullSafe(F.col("_before.own"))
        & F.col("prev_type").eqNullSafe(F.col("_before.type_uid"))
        & F.col("authority").eqNullSafe(F.col("_before.authority"))
    )
    link_ok = F.col("said_chain").eqNullSafe(F.col("chain_uid")) & F.when(F.col("_before").isNull(), F.col("prev_uid").isNull() & F.col("prev").isNull()).otherwise(same)
    return with_before.select("chain_uid", "seq", "event_uid", "own_ok", link_ok.alias("link_ok"))


def verify_chains(attested: DataFrame) -> DataFrame:
    """Per chain: events, failures, the first failing seq (null if none) and whether all hold."""
    bad = ~(F.col("own_ok") & F.col("link_ok"))
    return verify_events(attested).groupBy("chain_uid").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(bad).alias("n_bad"), F.min(F.when(bad, F.col("seq"))).alias("first_bad"), (F.count_if(bad) == 0).alias("ok")
    )


def chain_heads(attested: DataFrame) -> DataFrame:
    return attested.groupBy("chain_uid").agg(F.max("seq").alias("sequence"), F.max_by("event_uid", "seq").alias("head_uid"), F.max_by("fingerprint", "seq").alias("head"))


# --- Merkle log -----------------------------------------------------------------------------------

EMPTY_ROOT = hashlib.sha256(b"").hexdigest()
#: Leaves per perfect subtree that one task folds.
SUBTREE = 1 << 12


def leaf_hash(record) -> str:
    return hashlib.sha256(b"\x00" + record).hexdigest()


def node_hash(left: str, right: str) -> str:
    return hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()


def fold(hashes: list[str]) -> str:
    """The root of leaf or subtree hashes: pairs level by level, an odd one promoted."""
    if not hashes:
        return EMPTY_ROOT
    while len(hashes) > 1:
        hashes = [node_hash(hashes[i], hashes[i + 1]) if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0]


def leaves(df: DataFrame, index: str, record: str) -> DataFrame:
    """``(idx, h)``: leaf hashes of records (text or bytes), numbered by ``index``."""
    return df.select(F.col(index).alias("idx"), F.sha2(F.concat(F.unhex(F.lit("00")), F.col(record).cast("binary")), 256).alias("h"))


def numbered(df: DataFrame, order: str, block: int = 1 << 16) -> DataFrame:
    """``df`` with ``idx``: the rows from 0 without gaps in the order of the whole number ``order``, which is unique.

    Rows are counted within blocks of ``order``, which are raised by the rows of the blocks before.
    """
    from pyspark.sql import Window as W

    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sizes = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_block", F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_block").orderBy(order))
    return blocked.withColumn("idx", nth.cast("bigint") - 1).join(before, "_block").withColumn("idx", F.col("idx") + F.col("_before")).drop("_block", "_before")


def next_level(level: DataFrame) -> DataFrame:
    """The level above ``(idx, h)``: neighbours hashed together, an odd last one promoted."""
    pair = level.groupBy(F.call_function("div", F.col("idx"), F.lit(2)).alias("up")).agg(
        F.max(F.when(F.col("idx") % 2 == 0, F.col("h"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.col("h"))).alias("r")
    )
    joined = F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("l"), F.unhex("r")), 256)
    return pair.select(F.col("up").alias("idx"), F.when(F.col("r").isNull(), F.col("l")).otherwise(joined).alias("h"))


def merkle_root(level: DataFrame, subtree: int = SUBTREE) -> str:
    """The RFC 6962 root of ``(idx, h)`` numbered from 0 without gaps.

    Perfect subtrees are folded in the tasks that hold them, again and again until one task
    can fold the rest; each round divides the rows by ``subtree`` and is cut in the shared folder.
    """
    from ..session import cut

    spec = "idx bigint, h string"

    def folded(rows):
        for batch in rows:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([fold(h) for h in hashes], pa.string())], names=["idx", "h"])

    while True:
        few = level.limit(subtree + 1).collect()
        if len(few) <= subtree:
            return fold([r.h for r in sorted(few, key=lambda r: r.idx)])
        grouped = level.groupBy(F.call_function("div", F.col("idx"), F.lit(subtree)).alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"]).alias("hs"))
        level = cut(grouped.mapInArrow(folded, spec))


def inclusion_path(hashes: list[str], index: int) -> list[str]:
    """The audit path of a leaf, from the leaf up."""
    path = []
    while len(hashes) > 1:
        sibling = index ^ 1
        if sibling < len(hashes):
            path.append(hashes[sibling])
        hashes = [node_hash(hashes[i], hashes[i + 1]) if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
        index //= 2
    return path


def stored_levels(level: DataFrame, size: int) -> list[DataFrame]:
    """All levels of a tree from its leaves up, each written once to the shared folder; together twice the leaves."""
    from ..session import cut

    levels = [cut(level)]
    while size > 1:
        levels.append(cut(next_level(levels[-1])))
        size = (size + 1) // 2
    return levels


def _nodes(levels: list[DataFrame], wanted: list[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """The hashes of ``(level, idx)``, in one job over the levels concerned; missing ones are absent."""
    parts = [levels[k].where(F.col("idx").isin([i for n, i in wanted if n == k])).select(F.lit(k).alias("k"), "idx", "h") for k in sorted({k for k, _ in wanted})]
    return {(r.k, r.idx): r.h for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}


def inclusion_proof(levels: list[DataFrame], index: int) -> list[str]:
    """The audit path of a leaf by look-ups in the stored levels: one row per level, never the tree."""
    wanted = [(k, (index >> k) ^ 1) for k in range(len(levels) - 1)]
    found = _nodes(levels, wanted)
    return [found[w] for w in wanted if w in found]


def consistency_ranges(old: int, new: int) -> list[tuple[int, int]]:
    """The nodes ``(level, idx)`` of the RFC 6962 proof between two sizes of a log, in its order.

    Each is the root of a range that begins at a multiple of a power of two no less than its
    length; levels promote an odd last node, so that a range that ends with the log has one too.
    """
    out, start, end, m, whole = [], 0, new, old, True
    if not 0 < old < new:
        return []
    above: list[tuple[int, int]] = []
    while m != end - start:
        half = _split(end - start)
        if m <= half:
            above.append((start + half, end))
            end = start + half
        else:
            above.append((start, start + half))
            start, m, whole = start + half, m - half, False
    for a, b in ([] if whole else [(start, end)]) + above[::-1]:
        level = (b - a - 1).bit_length()
        out.append((level, a >> level))
    return out


def consistency_proof(levels: list[DataFrame], old: int, new: int) -> list[str]:
    """RFC 6962 proof that the log of the first ``old`` leaves is a prefix of the whole, of the stored levels."""
    wanted = consistency_ranges(old, new)
    found = _nodes(levels, wanted)
    return [found[w] for w in wanted]


def verify_inclusion(leaf: str, index: int, size: int, path: list[str], root: str) -> bool:
    if not 0 <= index < size:
        return False
    at, h = iter(path), leaf
    while size > 1:
        if index ^ 1 < size:
            sibling = next(at, None)
            if sibling is None:
                return False
            h = node_hash(sibling, h) if index & 1 else node_hash(h, sibling)
        index, size = index // 2, (size + 1) // 2
    return next(at, None) is None and h == root


def _split(n: int) -> int:
    return 1 << (n - 1).bit_length() - 1


def consistency_path(hashes: list[str], old: int) -> list[str]:
    """RFC 6962 proof that the log of the first ``old`` leaves is a prefix of the whole."""

    def sub(part: list[str], m: int, whole: bool) -> list[str]:
        if m == len(part):
            return [] if whole else [fold(part)]
        k = _split(len(part))
        if m <= k:
            return [*sub(part[:k], m, whole), fold(part[k:])]
        return [*sub(part[k:], m - k, False), fold(part[:k])]

    return sub(hashes, old, True) if 0 < old < len(hashes) else []


def verify_consistency(old: int, new: int, old_root: str, new_root: str, path: list[str]) -> bool:
    if old == new:
        return old_root == new_root and not path
    if old == 0 or old > new:
        return old == 0 and not path
    path = list(path)
    fn, sn = old - 1, new - 1
    while fn & 1:
        fn, sn = fn >> 1, sn >> 1
    if fn == 0 and old & (old - 1) == 0:
        path = [old_root, *path]
    if not path:
        return False
    fr = sr = path[0]
    for h in path[1:]:
        if sn == 0:
            return False
        if fn & 1 or fn == sn:
            fr, sr = node_hash(h, fr), node_hash(h, sr)
            while fn and not fn & 1:
                fn, sn = fn >> 1, sn >> 1
        else:
            sr = node_hash(sr, h)
        fn, sn = fn >> 1, sn >> 1
    return sn == 0 and fr == old_root and sr == new_root


# --- checkpoints, proof bundles, raw evidence -------------------------------------------------------

_SIGNED = ("chain_uid", "authority_uid", "sequence", "head_uid", "head_type_uid", "head", "merkle_root", "tree_size", "created_time")


def sign_checkpoint(checkpoint: dict, seed: bytes) -> dict:
    """A checkpoint with Ed25519 signature and public key over its canonical fields."""
    message = canonical({k: checkpoint[k] for k in _SIGNED if checkpoint.get(k) is not None}).encode()
    return checkpoint | {"public_key": ed25519.public_key(seed).hex(), "signature": ed25519.sign(seed, message).hex()}


def verify_checkpoint(checkpoint: dict, trusted: set[str] | None = None) -> bool:
    """Whether the signature holds, by the embedded key, which must be a trusted one if any are given."""
    try:
        key, signature = bytes.fromhex(checkpoint["public_key"]), bytes.fromhex(checkpoint["signature"])
    except (KeyError, ValueError, TypeError):
        return False
    if trusted is not None and checkpoint["public_key"] not in trusted:
        return False
    return ed25519.verify(key, canonical({k: checkpoint[k] for k in _SIGNED if checkpoint.get(k) is not None}).encode(), signature)


def resume(checkpoint: dict, stored_leaves: DataFrame, chain: str, authority: str) -> dict[str, dict]:
    """Heads for ``attest`` from a checkpoint, refused if it is of another chain or authority, or the leaves do not give its root."""
    if checkpoint.get("chain_uid") != chain or checkpoint.get("authority_uid") != authority:
        raise ValueError("the checkpoint is of another chain or authority")
    if stored_leaves.count() != checkpoint["tree_size"]:
        raise ValueError("leaves are missing or left over")
    if merkle_root(stored_leaves) != checkpoint["merkle_root"]:
        raise ValueError("the leaves do not give the signed root")
    return {chain: {"uid": checkpoint["head_uid"], "fingerprint": fingerprint(checkpoint["head"])} | ({"type_uid": checkpoint["head_type_uid"]} if checkpoint.get("head_type_uid") is not None else {})}


def proof_bundle(level: DataFrame, size: int, leaf: str, checkpoint: dict) -> dict:
    """A self-contained proof that a leaf is in the signed log; refused where the log is not the signed one or has no such leaf."""
    if size != checkpoint["tree_size"] or merkle_root(level) != checkpoint["merkle_root"]:
        raise ValueError("the log is not the one that was signed")
    at = level.where(F.col("h") == leaf).agg(F.min("idx")).first()[0]
    if at is None:
        raise LookupError("no such leaf")
    return {"leaf": leaf, "leaf_index": at, "tree_size": size, "path": inclusion_proof(stored_levels(level, size), at), "claimed_root": checkpoint["merkle_root"], "checkpoint": checkpoint}


def verify_segment(attested: DataFrame, checkpoint: dict, trusted: set[str] | None = None, whole: bool = False) -> list[str]:
    """What is wrong with the events of one chain and the signed checkpoint that binds their last; nothing if all holds.

    A segment may begin after the chain's first event: its first link is then taken as it is.
    With ``whole`` the events must be the whole chain.
    """
    if not verify_checkpoint(checkpoint, trusted):
        return ["the signature does not hold or is not trusted"]
    events = attested.where(F.col("chain_uid") == checkpoint["chain_uid"])
    first = events.agg(F.min("seq")).first()[0]
    if first is None:
        return ["there are no events"]
    broken = ~F.col("own_ok") | ~F.col("link_ok") & (F.lit(whole) | (F.col("seq") != first))
    n, n_bad = verify_events(events).agg(F.count(F.lit(1)), F.count_if(broken)).first()
    head = chain_heads(events).first()
    kind = events.where(F.col("seq") == head.sequence).select(F.get_json_object("event_json", "$.type_uid").try_cast("bigint")).first()[0]
    problems = [f"{n_bad} events do not hold"] if n_bad else []
    if n != checkpoint["sequence"] if whole else n > checkpoint["sequence"]:
        problems.append("the number of events does not fit the checkpoint")
    if (head.head_uid, head.head, kind) != (checkpoint["head_uid"], checkpoint["head"], checkpoint.get("head_type_uid")):
        problems.append("the last event is not the signed one")
    return problems


def check_bundle(bundle: dict, trusted: set[str] | None = None) -> bool:
    point = bundle["checkpoint"]
    return (
        verify_checkpoint(point, trusted) and point["merkle_root"] == bundle["claimed_root"] and point["tree_size"] == bundle["tree_size"]
        and verify_inclusion(bundle["leaf"], bundle["leaf_index"], bundle["tree_size"], bundle["path"], bundle["claimed_root"])
    )


def raw_evidence(events: DataFrame, vault: DataFrame) -> DataFrame:
    """Events with the bytes they came from: ``verified`` true, false, or null where the vault has no such record."""
    stored = vault.select("locator", F.col("raw").alias("vault_raw"))
    return events.join(stored, "locator", "left").withColumn("verified", F.when(F.col("vault_raw").isNotNull(), F.sha2("vault_raw", 256) == F.col("raw_sha256")))
