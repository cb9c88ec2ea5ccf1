"""Sinks: event archives, feature tables, dead letters, the vault, and network targets."""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import socket
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import is_private, locator
from ..session import table_exists

FEATURE_CONTRACT = "1"
MAX_DATAGRAM = 65_000
#: Seconds to connect, and for each transfer.
CONNECT_S, TRANSFER_S = 5, 10


def write_ndjson(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    events.select(F.col("event_json").alias("value")).write.mode(mode).text(path)


def write_dead_letters(letters: DataFrame, path: str, mode: str = "errorifexists") -> None:
    letters.write.mode(mode).json(path)


def write_archive(events: DataFrame, path: str, mode: str = "append") -> None:
    """``event_json, class_uid, activity_id, time`` by day of event time."""
    dt = F.date_format(F.timestamp_micros(F.call_function("div", F.col("time"), F.lit(1000))), "yyyy-MM-dd")
    events.select("event_json", "class_uid", "activity_id", "time", dt.alias("dt")).write.mode(mode).option("compression", "zstd").partitionBy("dt").parquet(path)


def feature_table(events: DataFrame) -> DataFrame:
    """The 24 columns of the feature contract: never null, absent is -1 or ''."""
    get = lambda path: F.get_json_object("event_json", f"$.{path}")
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c.cast("bigint"), F.lit(-1))
    has_time = F.col("time") > 0
    seconds = F.when(has_time, F.call_function("div", F.col("time"), F.lit(1_000_000_000)))
    at = F.timestamp_seconds(seconds)
    src, dst = get("src_endpoint.ip"), get("dst_endpoint.ip")
    return events.select(
        text(F.col("event_uid")).alias("event_uid"), F.coalesce(F.when(has_time, F.col("time")), F.lit(-1)).alias("time_ns"), number(seconds).alias("epoch_seconds"),
        text(F.col("pack_id")).alias("pack_id"), text(F.col("vendor")).alias("vendor"), text(F.col("product")).alias("product"), text(F.col("disposition")).alias("disposition"),
        *[number(F.col(c)).alias(c) for c in ("class_uid", "category_uid", "activity_id", "type_uid", "severity_id")],
        text(src).alias("src_ip"), number(get("src_endpoint.port").try_cast("bigint")).alias("src_port"), text(dst).alias("dst_ip"), number(get("dst_endpoint.port").try_cast("bigint")).alias("dst_port"),
        text(get("connection_info.protocol_name")).alias("protocol"), text(get("device.hostname")).alias("device_hostname"), number(F.hour(at)).alias("hour_of_day"), number(F.weekday(at)).alias("day_of_week"),
        is_private(src).alias("src_is_private"), is_private(dst).alias("dst_is_private"), (F.col("class_uid") == 2004).cast("bigint").alias("is_alert"), text(get("finding_info.uid")).alias("finding_uid"),
    )


def write_features(features: DataFrame, path: str, day: str, mode: str = "append") -> None:
    features.withColumn("dt", F.lit(day)).withColumn("contract", F.lit(FEATURE_CONTRACT)).write.mode(mode).partitionBy("dt").parquet(path)


def to_vault(raw: DataFrame, segment: int, key: bytes | None = None, scheme: str = "vault") -> DataFrame:
    """``(segment, offset, len, crc32, raw, locator)`` of records ``(raw, seq)`` in order of seq, optionally encrypted.

    Offsets are running sums. They are taken within blocks of seq and raised by the lengths of
    the blocks before, so that a segment of any size is not sorted in one task.
    """
    from pyspark.sql import Window as W

    sized = raw.withColumn("len", F.octet_length("raw").cast("bigint")).withColumn("_block", F.floor(F.col("seq") / (1 << 16)))
    blocks = sized.groupBy("_block").agg(F.sum("len").alias("_bytes"))
    base = blocks.select("_block", F.coalesce(F.sum("_bytes").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    running = F.coalesce(F.sum("len").over(W.partitionBy("_block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("offset", running).join(base, "_block").withColumn("offset", F.col("offset") + F.col("_base")).withColumn("segment", F.lit(segment).cast("bigint"))
    stored = F.col("raw") if key is None else F.aes_encrypt("raw", F.lit(key), F.lit("GCM"))
    return placed.select("segment", "offset", "len", F.crc32("raw").alias("crc32"), stored.alias("raw"), locator(F.col("segment"), F.col("offset"), F.col("len"), scheme).alias("locator"), "seq")


def append_vault(raw: DataFrame, path: str, segment: int, key: bytes | None = None) -> DataFrame:
    """Records ``(raw, seq)`` written as a new segment of a vault; a segment that is there is an error. Returns what was stored, without the bytes."""
    stored = to_vault(raw, segment, key)
    target = f"{path}/segment={segment}"
    if table_exists(raw.sparkSession, target):
        raise FileExistsError(target)
    stored.drop("segment", "seq").write.parquet(target)
    return raw.sparkSession.read.parquet(target).drop("raw").withColumn("segment", F.lit(segment).cast("bigint"))


def seal_vault(stored: DataFrame, path: str) -> None:
    """The index of segments, beside the vault: what ``unseal`` trusts in place of a scan. Segments that have one are left alone."""
    index = f"{path}-index"
    columns = stored.select("segment", "offset", "len", "crc32", "locator")
    if table_exists(stored.sparkSession, index):
        columns = columns.join(stored.sparkSession.read.parquet(index).select("segment").distinct(), "segment", "left_anti")
    columns.write.mode("append").parquet(index)


def vault_key(passphrase: str, path: str, spark: SparkSession) -> bytes:
    """The key of a vault: of a passphrase and the vault's salt, which is made with its first key (scrypt)."""
    name = f"{path}-salt"
    if table_exists(spark, name):
        salt = bytes(spark.read.format("binaryFile").load(name).first().content)
    else:
        salt = os.urandom(16)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
        out.write(bytearray(salt))
        out.close()
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def summary(events: DataFrame) -> DataFrame:
    """One row per event as a console lists it: uid, product, classification, time, endpoints, disposition, pack and the event itself."""
    get = lambda path: F.get_json_object("event_json", f"$.{path}")
    number = lambda path: get(path).try_cast("bigint")
    return events.select(
        get("metadata.uid").alias("uid"), get("metadata.product.vendor_name").alias("vendor"), get("metadata.product.name").alias("product"), get("metadata.log_format").alias("log_format"),
        *[number(c).alias(c) for c in ("class_uid", "activity_id", "type_uid", "severity_id", "time")],
        get("src_endpoint.ip").alias("src_ip"), number("src_endpoint.port").alias("src_port"), get("dst_endpoint.ip").alias("dst_ip"), number("dst_endpoint.port").alias("dst_port"),
        "disposition", F.col("pack_id").alias("pack"), "locator", "event_json",
    )


def check_paths(inputs: list[str], outputs: list[str]) -> None:
    """Refuses outputs that are inputs, or one another."""
    real = [os.path.realpath(p) for p in outputs]
    if len(set(real)) < len(real) or set(real) & {os.path.realpath(p) for p in inputs}:
        raise ValueError("an output path is used twice or is an input")


# --- network targets: per partition, at least once, ids make replays idempotent -----------------------


def _post(url: str, body: bytes, headers: dict[str, str]) -> dict:
    parts = urlsplit(url)
    if parts.scheme != "http":
        raise ValueError("http:// only")
    con = http.client.HTTPConnection(parts.hostname, parts.port or 80, timeout=CONNECT_S)
    try:
        con.connect()
        con.sock.settimeout(TRANSFER_S)
        con.request("POST", parts.path or "/", body, headers)
        answer = con.getresponse()
        text = answer.read(64 << 10)
        if answer.status >= 300:
            raise OSError(f"{url}: {answer.status} {text[:200]!r}")
        return json.loads(text or b"{}")
    finally:
        con.close()


def bulk_body(rows: list[dict], index: str) -> bytes:
    """A bulk request: an action with the event's uid as id before every event."""
    return "".join(json.dumps({"index": {"_index": index, "_id": r["event_uid"]}}) + "\n" + r["event_json"] + "\n" for r in rows).encode()


def _in_parts(rows, size: int):
    part: list[dict] = []
    for r in rows:
        part.append(r.asDict())
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part


def send_bulk(events: DataFrame, url: str, index: str, size: int = 500) -> None:
    def run(rows):
        for part in _in_parts(rows, size):
            answer = _post(f"{url}/_bulk", bulk_body(part, index), {"Content-Type": "application/x-ndjson"})
            if answer.get("errors"):
                raise OSError(f"refused items: {[i for i in answer.get('items', []) if i.get('index', {}).get('error')][:3]}")

    events.select("event_uid", "event_json").foreachPartition(run)


def send_collector(events: DataFrame, url: str, token: str, source: str = "siltstone", size: int = 500) -> None:
    """HTTP event collector: ``{event, source, sourcetype}`` with a token; a code other than 0 is an error."""
    def run(rows):
        for part in _in_parts(rows, size):
            body = "".join(json.dumps({"event": json.loads(r["event_json"]), "source": source, "sourcetype": "ocsf"}) for r in part).encode()
            if _post(url, body, {"Authorization": f"Splunk {token}"}).get("code", 0) != 0:
                raise OSError("the collector refused events")

    events.select("event_json").foreachPartition(run)


def send_udp(events: DataFrame, host: str, port: int) -> int:
    """One datagram per event, best effort; returns how many were too long and dropped."""
    dropped = events.sparkSession.sparkContext.accumulator(0)

    def run(rows):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for r in rows:
                data = r.event_json.encode()
                if len(data) > MAX_DATAGRAM:
                    dropped.add(1)
                else:
                    s.sendto(data, (host, port))

    events.select("event_json").foreachPartition(run)
    return dropped.value


def fan_out(events: DataFrame, *sinks) -> None:
    """Events to several sinks, each a function of a data frame; worked out once. All are tried, then the first failure is raised."""
    from ..session import cut

    stored, failures = cut(events), []
    for sink in sinks:
        try:
            sink(stored)
        except Exception as error:  # noqa: BLE001
            failures.append(error)
    if failures:
        raise failures[0]
