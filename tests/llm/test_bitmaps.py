import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import bitmaps

SCHEMA = "epoch_seconds long, pack_id string, class_uid long, src_ip string, dst_ip string, word int, id int"


def frame(spark, n=600):
    rng = random.Random(5)
    ip = lambda: rng.choice(["", None, "hot", *[f"10.0.0.{i}" for i in range(120)]])
    rows = [(rng.choice([-1, None, 86_399, 86_400, 200_000]), rng.choice(["p", "q", None]), rng.choice([1, 2]), ip(), ip(), 0, 0) for _ in range(n)]
    return spark.createDataFrame(rows + rows[:40], SCHEMA), rows


def test_cube_against_sets(spark):
    df, rows = frame(spark)
    want: dict = {}
    names = bitmaps.DIMENSIONS
    for at, pack, cls, src, dst, *_ in rows:
        dims = {"day": None if at is None else at // 86_400, "pack_id": pack, "class_uid": cls}
        for k in range(4):
            for by in itertools.combinations(names, k):
                key = ("+".join(by) or "all", *[dims[n] if n in by else None for n in names])
                s, d = want.setdefault(key, (set(), set()))
                s |= {src} if src else set()
                d |= {dst} if dst else set()
    want = {k: (len(s), len(d), len(s | d), 0) for k, (s, d) in want.items() if s | d}
    got = {tuple(r[:4]): tuple(r[4:]) for r in bitmaps.cube(df).collect()}
    assert got == want


def test_runs_merge_to_the_whole(spark, tmp_path):
    """Each run codes with the stored dictionary as the one before left it; ids never change."""
    df, _ = frame(spark)
    first, second = df.where("src_ip < '10.0.0.5' or src_ip is null"), df.where("src_ip >= '10.0.0.5'")
    whole = {tuple(r) for r in bitmaps.cube(df).collect()}
    assert {tuple(r) for r in bitmaps.cube_of_runs([first, second]).collect()} == whole
    path = str(tmp_path / "addresses")
    one, dictionary = bitmaps.bitmaps(first, bitmaps.Dictionary.create(spark, path))
    ids = {r.address: r.id for r in dictionary.table().collect()}
    two, dictionary = bitmaps.bitmaps(second, bitmaps.Dictionary.open(spark, path))
    later = {r.address: r.id for r in dictionary.table().collect()}
    assert sorted(later.values()) == list(range(dictionary.size)) and ids.items() < later.items()
    assert {tuple(r) for r in bitmaps.levels(one.union(two)).collect()} == whole


def test_results_of_different_dictionaries_do_not_merge(spark):
    df, _ = frame(spark, 20)
    one, two = bitmaps.bitmaps(df)[0], bitmaps.bitmaps(df)[0]
    with pytest.raises(ValueError):
        one.union(two)
    with pytest.raises(ValueError):
        one.union(one.merged("day"))


def test_containers_sparse_and_dense():
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(6):
        for _ in range(3):
            sets = [set(rng.sample(range(65536), rng.choice([0, 5, 3000, 4095, 4096, 30000]) if g != 2 else 7)) for _ in range(2)]
            rows.append((g, *[bitmaps._pack(np.array(sorted(x), np.int64), 1)[0][0] for x in sets]))
            for k in range(2):
                want.setdefault(g, [set(), set()])[k] |= sets[k]
    table = pa.table({"g": [r[0] for r in rows], "src": pa.array([r[1] for r in rows], pa.binary()), "dst": pa.array([r[2] for r in rows], pa.binary())})
    got = bitmaps._fold(table, np.array([r[0] for r in rows]))
    members = lambda c: set(np.flatnonzero(np.unpackbits(bitmaps.to_bits(c), bitorder="little")).tolist())
    for g, (src, dst) in want.items():
        assert members(got["src"][g]) == src and members(got["dst"][g]) == dst
        assert (got["n_src"][g], got["n_dst"][g], got["n_any"][g]) == (len(src), len(dst), len(src | dst))
        assert members(bitmaps._and(got["src"][g], got["dst"][g])[0]) == src & dst
        assert all(len(got[side][g]) == min(2 * got[f"n_{side}"][g], bitmaps.BITMAP_BYTES) for side in ("src", "dst"))


def test_returning_addresses_and_empty_table(spark):
    df, rows = frame(spark)
    days: dict = {}
    for at, _, _, src, dst, *_ in rows:
        if at is not None:
            for k, ip in enumerate((src, dst)):
                if ip:
                    days.setdefault(at // 86_400, [set(), set()])[k].add(ip)
    want = {(d, len(s & days[d - 1][0]), len(t & days[d - 1][1])) for d, (s, t) in days.items() if d - 1 in days}
    assert {tuple(r) for r in bitmaps.returning(df).collect()} == want
    assert bitmaps.cube(df.limit(0)).count() == 0 and bitmaps.returning(df.limit(0)).count() == 0
