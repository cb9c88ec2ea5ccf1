import io
import random
import socket
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import fused
from siltstone.packs.spec import load_library
from siltstone.sources import demo, lines, sinks
from siltstone.streaming.pipeline import UdpReader

PACKS, _ = load_library()


@pytest.mark.parametrize("split", [1, 2, 3, 5, 7, 64, 1 << 26])
def test_files_are_read_byte_for_byte_in_splits_of_any_size(spark, tmp_path, split):
    rng = random.Random(split)
    files = [b"", b"\n", b"x", b"a\r\n\nb\xff\n", b"".join(bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(9))) for _ in range(9))]
    for i, data in enumerate(files):
        (tmp_path / f"f{i}.log").write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"no\n")
    got = lines.read_lines(spark, str(tmp_path), split_bytes=split).collect()
    for i, data in enumerate(files):
        mine = sorted((r.locator, bytes(r.raw)) for r in got if r.origin.endswith(f"f{i}.log"))
        assert [x for _, x in mine] == data.splitlines(keepends=True) if b"\r" not in data else [x for _, x in mine] == [b"a\r\n", b"\n", b"b\xff\n"]
    assert len({r.locator for r in got}) == len(got)
    with pytest.raises(FileNotFoundError):
        lines.read_lines(spark, str(tmp_path / "none"))


def test_equal_lines_are_different_events(spark, tmp_path):
    (tmp_path / "a.log").write_text("same\nsame\nsame")
    events = fused.normalise(lines.read_lines(spark, str(tmp_path / "a.log")), PACKS, 2025, columns=("event_uid", "text"))
    assert events.select("event_uid").distinct().count() == 3
    assert lines.ingest_lines(spark, ["x", " ", "x"]).select("locator").distinct().count() == 2
    piped = lines.read_stdin(spark, io.BytesIO(b"one\ntwo")).orderBy("locator").collect()
    assert [bytes(r.raw) for r in piped] == [b"one\n", b"two"] and piped[0].transport == "stdin"


def test_long_lines_over_many_chunks(spark, tmp_path):
    data = b"a" * 3_000_000 + b"\n" + b"b" * 2_500_000
    (tmp_path / "long.log").write_bytes(data)
    got = lines.read_lines(spark, str(tmp_path / "long.log"), split_bytes=700_000).orderBy("locator").collect()
    assert [bytes(r.raw) for r in got] == data.splitlines(keepends=True)


def reader(**options):
    return UdpReader({"host": "127.0.0.1", "port": "0"} | options)


def fed(udp, *texts):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for t in texts:
            s.sendto(t, udp.socket.getsockname())
    for _ in range(100):
        with udp.lock:
            if udp.db.execute("SELECT count(*) FROM record").fetchone()[0] + udp.dropped >= len(texts):
                return
        time.sleep(0.02)


def test_datagrams_after_a_restart_without_spool():
    """Offsets go on from the checkpoint's; nothing that arrived since is passed over."""
    udp = reader()
    fed(udp, b"a", b"b")
    rows, end = udp.read({"n": 3})
    assert [bytes(r[0]) for r in rows] == [b"a", b"b"] and end == {"n": 5}
    udp.commit(end)
    assert list(udp.read(end)[0]) == [] and udp.read(end)[1] == {"n": 5}


def test_datagrams_survive_a_restart_with_a_spool(tmp_path):
    spool = str(tmp_path / "spool.db")
    udp = reader(spool=spool)
    fed(udp, b"a", b"b", b"c")
    rows, end = udp.read({"n": 0})
    assert len(list(rows)) == 3
    udp.commit({"n": 2})
    udp.socket.close()
    again = reader(spool=spool)
    fed(again, b"d", b"e")
    for _ in range(100):
        if again.read({"n": 3})[1]["n"] >= 5:
            break
        time.sleep(0.02)
    assert [bytes(r[0]) for r in again.readBetweenOffsets({"n": 2}, {"n": 3})] == [b"c"]
    assert [bytes(r[0]) for r in again.read({"n": 3})[0]] == [b"d", b"e"]


def test_waiting_datagrams_are_bounded():
    udp = reader(most="2")
    fed(udp, b"a", b"b", b"c")
    assert udp.dropped == 1 and udp.read({"n": 0})[1] == {"n": 2}


def test_vault_segments_are_sealed_and_recovered(spark, tmp_path):
    path = str(tmp_path / "vault")
    key = sinks.vault_key("a passphrase", path, spark)
    assert len(key) == 32 and key == sinks.vault_key("a passphrase", path, spark) != sinks.vault_key("other", path, spark)
    raw = spark.createDataFrame([(bytearray(f"record {i}\n".encode() * (i % 3)), i) for i in range(30)], "raw binary, seq long")
    one = sinks.append_vault(raw, path, 1)
    sinks.append_vault(raw, path, 2)
    sinks.seal_vault(one, path)
    sinks.seal_vault(one, path)
    with pytest.raises(FileExistsError):
        sinks.append_vault(raw, path, 1)
    index = lines.unseal(spark, path)
    assert {(r.segment, r.sealed): r["count"] for r in index.groupBy("segment", "sealed").count().collect()} == {(1, True): 30, (2, False): 30}
    damaged = sinks.to_vault(raw, 3).drop("seq").withColumn("raw", F.when(F.col("offset") == 91, F.lit(b"x")).otherwise(F.col("raw")))
    damaged.drop("segment").write.parquet(f"{path}/segment=3")
    sinks.to_vault(raw, 4).drop("seq", "segment").where("offset <> 91").write.parquet(f"{path}/segment=4")
    ends = {r.segment: r.end for r in lines.unseal(spark, path).groupBy("segment").agg(F.max(F.col("offset") + F.col("len")).alias("end")).collect()}
    assert ends[3] == 91 and ends[4] == 91 and ends[1] == ends[2] > 91


def test_summary_recent_and_fan_out(spark, tmp_path):
    raw = demo.lines(spark, 40, seed=3)
    events = fused.normalise(raw, PACKS, 2025)
    rows = sinks.summary(events).collect()
    assert len(rows) == 40 and {r.pack for r in rows} >= {"linux-iptables-firewall", "openssh-auth"} and all(r.uid and r.class_uid is not None for r in rows)
    numbered = spark.range(600).withColumnRenamed("id", "seq")
    assert [lines.recent(numbered, limit=k).count() for k in (-1, 0, 7, 10_000)] == [1, 1, 7, 500] and lines.recent(numbered).first().seq == 599

    def failing(df):
        raise OSError("no")

    with pytest.raises(OSError):
        sinks.fan_out(events, failing, lambda df: sinks.write_ndjson(df, str(tmp_path / "out")))
    assert len(spark.read.text(str(tmp_path / "out")).collect()) == 40


def test_demo_sources_are_seeded_and_replayed(spark, tmp_path):
    a, b = ([bytes(r.raw) for r in demo.lines(spark, 60, seed=s).orderBy("locator").collect()] for s in (1, 1))
    assert a == b != [bytes(r.raw) for r in demo.lines(spark, 60, seed=2).orderBy("locator").collect()] and len(demo.DEVICES) >= 9
    parsed = fused.normalise(demo.lines(spark, 200), PACKS, 2025, columns=("disposition", "pack_id"))
    assert parsed.where("disposition <> 'parsed'").count() == 0 and parsed.select("pack_id").distinct().count() == len(demo.DEVICES)
    udp = reader()
    host, port = udp.socket.getsockname()
    began = time.monotonic()
    assert demo.replay([b"x\n", b"y"], host, port, eps=50, count=11) == 11 and 0.15 < time.monotonic() - began < 5
    registry = demo.Simulators()
    registry.start("one", [b"z"], host, port, eps=200)
    registry.start("two", [b"w"], host, port, eps=200)
    assert registry.running() == ["one", "two"]
    with pytest.raises(ValueError):
        registry.start("one", [b"z"], host, port, eps=1)
    time.sleep(0.2)
    assert registry.stop("one") > 0 and registry.running() == ["two"] and registry.stop("two") > 0
