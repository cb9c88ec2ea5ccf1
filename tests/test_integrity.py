import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import ed25519, jcs
from siltstone.operators import integrity as I


def test_numbers_and_keys():
    cases = {1e21: "1e+21", 333333333.33333329: "333333333.3333333", 1e-7: "1e-7", 0.000001: "0.000001", -0.0: "0", 4.5: "4.5", 1e30: "1e+30", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 100.0: "100"}
    assert {x: jcs.number(x) for x in cases} == cases
    assert jcs.canonical({"b": [True, None, 2**63], "a": "\n\u00f6", "\U0001f600": 1, "\ufb33": 2}) == '{"a":"\\n\u00f6","b":[true,null,9223372036854775808],"\U0001f600":1,"\ufb33":2}'
    with pytest.raises(ValueError):
        jcs.canonical(float("nan"))


def test_signature_vector():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = ed25519.sign(seed, b"")
    assert ed25519.verify(ed25519.public_key(seed), b"", signature) and not ed25519.verify(ed25519.public_key(seed), b"x", signature)


def chained(spark, n=60):
    return spark.createDataFrame([(f"c{i % 3}" if i != 7 else None, i, f"e{i}", json.dumps({"type_uid": 1, "message": f"ü{i}", "metadata": {"uid": f"e{i}"}})) for i in range(n)], "chain_uid string, seq long, event_uid string, event_json string")


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_chain_and_tampering(spark, block):
    attested = I.attest(chained(spark)).cache()
    assert all(r.ok for r in I.verify_chains(attested).collect()) and attested.count() == 59
    rows = [r.asDict() for r in attested.collect()]
    broken = [r | {"event_json": r["event_json"].replace("ü30", "u30")} for r in rows if r["seq"] != 12]
    bad = I.verify_events(spark.createDataFrame(broken, attested.schema), block).where("not (own_ok and link_ok)").collect()
    assert {(r.seq, r.own_ok, r.link_ok) for r in bad} == {(30, False, True), (15, True, False)}
    assert I.verify_events(attested.limit(0), block).count() == 0


def test_resume_equals_one_run(spark):
    whole = {r.seq: r.fingerprint for r in I.attest(chained(spark)).collect()}
    first = I.attest(chained(spark).where("seq < 30"))
    heads = {r.chain_uid: {"uid": r.head_uid, "type_uid": 1, "fingerprint": I.fingerprint(r.head)} for r in I.chain_heads(first).collect()}
    rest = {r.seq: r.fingerprint for r in I.attest(chained(spark).where("seq >= 30"), heads=heads).collect()}
    assert rest == {k: v for k, v in whole.items() if k >= 30}


def test_ranges_of_consistency_proofs_are_nodes_of_the_levels():
    for n in range(1, 40):
        hs = [I.leaf_hash(bytes([i])) for i in range(n)]
        levels = [hs]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([I.node_hash(*last[i : i + 2]) if i + 1 < len(last) else last[i] for i in range(0, len(last), 2)])
        for m in range(1, n + 1):
            assert [levels[k][i] for k, i in I.consistency_ranges(m, n)] == I.consistency_path(hs, m)


def test_segments_are_bound_to_their_checkpoint(spark):
    attested = I.attest(chained(spark)).cache()
    chain = attested.first().chain_uid
    events = attested.where(F.col("chain_uid") == chain)
    head = I.chain_heads(events).first()
    n = events.count()
    sign = lambda **x: I.sign_checkpoint({"chain_uid": chain, "authority_uid": "authority", "sequence": n, "head_uid": head.head_uid, "head_type_uid": 1, "head": head.head, "created_time": 1} | x, b"s" * 32)
    point = sign()
    assert I.verify_segment(attested, point, whole=True) == [] and I.verify_segment(attested.where("seq > 20"), point) == []
    assert I.verify_segment(attested.where("seq > 20"), point, whole=True) and I.verify_segment(attested.where(F.col("seq") < head.sequence), point)
    assert I.verify_segment(attested, sign(sequence=1)) and I.verify_segment(attested, point | {"sequence": n + 1}) and I.verify_segment(attested, point, {"00"}) and I.verify_segment(attested.limit(0), point)
    altered = attested.withColumn("event_json", F.when(F.col("seq") == 30, F.replace("event_json", F.lit("ü30"), F.lit("u30"))).otherwise(F.col("event_json")))
    assert any("hold" in p for c in {r.chain_uid for r in attested.where("seq = 30").collect()} for p in I.verify_segment(altered, sign() if c == chain else sign(chain_uid=c)))


def test_every_leaf_and_prefix():
    for n in range(1, 18):
        hs = [I.leaf_hash(bytes([i])) for i in range(n)]
        root = I.fold(hs)
        for i in range(n):
            path = I.inclusion_path(hs, i)
            assert I.verify_inclusion(hs[i], i, n, path, root) and not I.verify_inclusion(hs[i], i, n, [*path, root], root)
        for m in range(1, n + 1):
            assert I.verify_consistency(m, n, I.fold(hs[:m]), root, I.consistency_path(hs, m))
            assert m == n or not I.verify_consistency(m, n, root, root, I.consistency_path(hs, m))


def test_distributed_root_proof_and_bundle(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(37)], "i long, r string")
    level = I.leaves(df, "i", "r")
    hs = [I.leaf_hash(f"r{i}".encode()) for i in range(37)]
    assert I.merkle_root(level, subtree=4) == I.merkle_root(level) == I.fold(hs) and I.merkle_root(level.limit(0)) == I.EMPTY_ROOT
    levels = I.stored_levels(level, 37)
    assert len(levels) == 7 and I.inclusion_proof(levels, 36) == I.inclusion_path(hs, 36) and I.inclusion_proof(levels, 3) == I.inclusion_path(hs, 3)
    for old in (1, 5, 32, 36, 37):
        assert I.consistency_proof(levels, old, 37) == I.consistency_path(hs, old)
    point = I.sign_checkpoint({"chain_uid": "c", "authority_uid": "a", "sequence": 36, "head_uid": "e", "head": "h", "merkle_root": I.fold(hs), "tree_size": 37, "created_time": 1}, b"s" * 32)
    bundle = I.proof_bundle(level, 37, hs[5], point)
    assert I.check_bundle(bundle) and I.check_bundle(bundle, {point["public_key"]}) and not I.check_bundle(bundle, {"00"}) and not I.check_bundle(bundle | {"leaf": hs[6]})
    assert bundle["leaf_index"] == 5
    with pytest.raises(LookupError):
        I.proof_bundle(level, 37, "00", point)
    with pytest.raises(ValueError):
        I.resume(point, level, "c", "other")
    with pytest.raises(NotImplementedError):
        I.fingerprint("x", "BLAKE3")


def test_root_of_all_raw_events_and_of_nations(spark, tmp_path):
    from siltstone.plans import reference

    ids = [i * 30_000 + 7 for i in range(9_000)]
    spark.createDataFrame([(i, f"event {i}".encode()) for i in reversed(ids)], "raw_id long, raw binary").write.parquet(f"{tmp_path}/raw_events.parquet")
    got = reference.merkle(spark, str(tmp_path)).first()
    assert got.n == 9_000 and got.root == I.fold([hashlib.sha256(b"\0" + f"event {i}".encode()).hexdigest() for i in ids])
    names = [f"nation {i}" for i in range(25)]
    level = I.leaves(spark.createDataFrame(list(enumerate(names)), "idx long, name string"), "idx", "name")
    assert I.merkle_root(level, subtree=8) == I.fold([hashlib.sha256(b"\0" + n.encode()).hexdigest() for n in names])
