import random

from siltstone.operators import featureblocks, watermark

H = 3600 * 10**9
ENV = "event_uid string, received_at long, peer string, receiver_id string, origin string"
FEAT = "event_uid string, time_ns long, pack_id string"


def test_refused_against_the_definition(spark):
    rng = random.Random(7)
    events = [(f"e{i}", rng.choice([-1, 10**18 + rng.randrange(40 * H), -5 * H, 10**18]), rng.choice("pq")) for i in range(400)]
    receipts = [(rng.choice([e[0], None]), rng.choice([None, e[1] + rng.randrange(9 * H), e[1] + 7 * H]), None, rng.choice(["a", "b", None]), None) for e in events for _ in range(rng.randrange(4))]
    receipts = [r for r in receipts if r[1] is None or r[1] > 10**17]
    first = {}
    for uid, at, *_ in receipts:
        if uid and at is not None:
            first[uid] = min(at, first.get(uid, at))
    want = {(u, t // H * 3600) for u, t, _ in events if t != -1 and u in first and first[u] > (t // H + 7) * H}
    env, feat = spark.createDataFrame(receipts, ENV), spark.createDataFrame(events + events[:50], FEAT)
    got = [tuple(r) for r in watermark.refused(env.union(env), feat).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert watermark.refused(env.limit(0), feat).count() == 0 and watermark.refused(env, feat.limit(0)).count() == 0


def test_a_period_waits_for_every_live_source_and_not_for_idle_ones(spark):
    at = lambda s: s * 10**9
    rows = [("a", at(7190)), ("a", at(7201)), ("b", at(7100)), ("b", at(7300)), ("c", at(100))]
    df = spark.createDataFrame(rows, "source string, at_ns long")
    closing = {r.period_end: r.close_ns for r in watermark.close_instants(df, lateness_s=3600, idle_s=900).collect()}
    assert closing[3600] == at(7300)
    only = {r.period_end: r.close_ns for r in watermark.close_instants(df.where("source = 'b' and at_ns < 7200000000000"), 3600, 900).collect()}
    assert only[3600] == at(3600 + 3600 + 900)


def test_sources_decide_what_is_published_at_the_close(spark):
    """Without the clock of a source its hour closes earlier, and its late event is diverted."""
    at = lambda s: (1_000_000_800 + s) * 10**9
    feat = spark.createDataFrame([("e", at(100), "p"), ("f", at(200), "p"), ("g", at(300), "p")], FEAT)
    due = 3600 + watermark.LATENESS_S
    rows = [("e", at(400), None, "a", None), (None, at(due - 5), None, "a", None), (None, at(due + 1), None, "a", None), (None, at(due - 9), None, "slow", None), ("f", at(due + 300), None, "b", None), (None, at(due + 600), None, "slow", None), ("g", at(3600 + 6 * 3600 + 1), None, "a", None)]
    env = spark.createDataFrame(rows, ENV)
    got = {r.event_uid: (r.outcome, r.close_ns) for r in watermark.judged(env, feat).collect()}
    assert got == {"e": ("in_time", at(due + 600)), "f": ("in_time", at(due + 600)), "g": ("refused", at(due + 600))}
    without = env.where("receiver_id <> 'slow'")
    got = {r.event_uid: (r.outcome, r.close_ns) for r in watermark.judged(without, feat).collect()}
    assert got == {"e": ("in_time", at(due + 1)), "f": ("corrected", at(due + 1)), "g": ("refused", at(due + 1))}
    assert [r.event_uid for r in watermark.diverted(without, feat).orderBy("event_uid").collect()] == ["f", "g"]
    published = [(r.version, r.n_events, r.published_ns) for r in watermark.corrections(without, feat).orderBy("version").collect()]
    assert published == [(0, 1, at(due + 1)), (1, 2, at(due + 1 + watermark.STEP_S))]
    hour = watermark.hourly(without, feat).first()
    assert (hour.n_at_close, hour.n_final, hour.n_diverted, hour.n_refused) == (1, 2, 2, 1)


FEATURES = "event_uid string, src_ip string, class_uid long, severity_id long, time_ns long, block int, n int"


def test_feature_blocks(spark):
    rows = [("e1", "a", 4001, 1, 5, 0, 0), ("e1", "a", 4001, 1, 5, 0, 0), ("e2", "a", 4001, 1, 9, 0, 0), ("e3", "a", 2004, 3, 7, 0, 0), ("e4", "b", -1, -1, -1, 0, 0), ("e5", "", 1, 1, 1, 0, 0), ("e6", None, 1, 1, 1, 0, 0), ("e7", "c", None, None, None, 0, 0), (None, "c", 1, 2, 3, 0, 0), (None, "c", 1, 2, 3, 0, 0)]
    wide = featureblocks.entity_features(spark.createDataFrame(rows, FEATURES))
    got = {r.src_ip: r for r in wide.collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].n, got["a"].last_time_ns, got["a"].severity_total) == (3, 9, 5) and got["c"].n == 3
    assert [tuple(x) for x in got["a"].block_4] == [(4001, 1, 2, 9, 2)] and [tuple(x) for x in got["a"].block_2] == [(2004, 3, 1, 7, 3)] and got["a"].block_1 == []
    flat = {r.src_ip: r for r in featureblocks.widen(wide, [(4001, 1), (2004, 3)]).collect()}
    assert (flat["a"].n_4001_1, flat["a"].last_2004_3, flat["b"].n_4001_1, flat["b"].last_4001_1) == (2, 7, 0, None)
    assert featureblocks.catalogue(wide) == [(-1, -1), (1, 2), (2004, 3), (4001, 1)]
    flat = {r.src_ip: r for r in featureblocks.widen(wide, featureblocks.catalogue(wide)).collect()}
    assert (flat["b"].n_m1_m1, flat["b"].last_m1_m1, flat["b"].total_m1_m1, flat["a"].n_m1_m1, flat["c"].n_1_2) == (1, -1, -1, 0, 2)
    assert featureblocks.entity_features(spark.createDataFrame([], FEATURES)).count() == 0


def test_blocks_of_negative_classes_are_where_the_writer_puts_them(spark):
    classes = [-9999, -1001, -1000, -999, -1, 0, 999, 1000, 7999, 8000]
    df = spark.createDataFrame([(str(c), "x", c, 1, 1, 0, 0) for c in classes], FEATURES)
    stored = featureblocks.bucketed(featureblocks.event_types(df), 2)
    assert {r.class_uid: r.block for r in stored.collect()} == {c: featureblocks.block_of(c) for c in classes}
