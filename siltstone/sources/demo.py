"""Lines to try the engine with: seeded devices of differing wire formats, replay at a given rate, running simulators."""

from __future__ import annotations

import itertools
import socket
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Devices: the pack that reads them and how they write, ``{src}`` and so on being drawn for each line.
DEVICES = {
    "linux-iptables-firewall": "{stamp} gate kernel: INBOUND TCP: IN=br0 PHYSIN=eth0 OUT=br0 SRC={src} DST={dst} PROTO=TCP SPT={sport} DPT={dport}",
    "fortinet-fortigate-traffic": "devname=fw type=traffic srcip={src} dstip={dst} srcport={sport} dstport={dport} proto=6 action=accept",
    "generic-cef-network": "CEF:0|Acme|Box|1|1|n|5|src={src} dst={dst} spt={sport} dpt={dport}",
    "squid-proxy-access": "{epoch}.123     45 {src} TCP_MISS/200 512 GET http://host.example/{sport} - DIRECT/{dst} text/html",
    "apache-access-http": '{src} - ann [10/Oct/2025:13:55:36 +0000] "GET /{sport} HTTP/1.1" 200 23',
    "zeek-conn": "{epoch}.5\tC1\t{src}\t{sport}\t{dst}\t{dport}\ttcp\t-\t1.5\t10\t20\tSF\t-\t0\tShADadFf\t5\t300\t4\t200\t-",
    "pfsense-filterlog": "<134>{stamp} gate filterlog[1]: 5,,,100,em0,match,pass,in,4,0x0,,64,1,0,none,6,tcp,60,{src},{dst},{sport},{dport}",
    "suricata-eve-alert": '{"timestamp":"2025-10-11T01:02:03.5+0000","event_type":"alert","src_ip":"{src}","src_port":{sport},"dest_ip":"{dst}","dest_port":{dport},"proto":"TCP","alert":{"signature":"s","severity":2}}',
    "sendmail-mta": "{stamp} post sendmail[2606]: j2D9FD3X026: from=ann, size={sport}, class=0, relay={dst}",
    "openssh-auth": "{stamp} gate sshd[7]: Failed password for ann from {src} port {sport} ssh2",
    "linux-syslog-host": "<30>{stamp} combo cron[19939]: job {sport} done",
}


def lines(spark: SparkSession, n: int, seed: int = 0, devices: Iterable[str] = tuple(DEVICES), start_s: int = 1_760_000_000) -> DataFrame:
    """``n`` records of the devices in turn, the same for the same seed; made where they are wanted, not in the driver."""
    chosen = list(devices)
    draw = lambda salt, most: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(most)).cast("string")
    at = F.lit(start_s) + F.col("id")
    values = {
        "src": F.concat(F.lit("192.0.2."), draw("src", 255)), "dst": F.concat(F.lit("198.51.100."), draw("dst", 255)), "sport": draw("sport", 65_535), "dport": draw("dport", 1024),
        "epoch": at.cast("string"), "stamp": F.concat(F.date_format(F.timestamp_seconds(at), "MMM "), F.lpad(F.dayofmonth(F.timestamp_seconds(at)).cast("string"), 2, " "), F.date_format(F.timestamp_seconds(at), " HH:mm:ss")),
    }
    line = F.get(F.array(*[F.lit(DEVICES[d]) for d in chosen]), (F.col("id") % len(chosen)).cast("int"))
    for name, value in values.items():
        line = F.replace(line, F.lit("{" + name + "}"), value)
    return spark.range(n).select(
        line.cast("binary").alias("raw"), (at * 1_000_000_000).alias("received_at"), F.lit(None).cast("string").alias("peer"), F.lit("demo").alias("transport"),
        F.lit("demo").alias("receiver_id"), F.lit(None).cast("string").alias("origin"), F.format_string("demo:%d:%016x", F.lit(seed), "id").alias("locator"),
    )


def replay(records: Iterable[bytes], host: str, port: int, eps: float, count: int | None = None, stopped: Callable[[], bool] = lambda: False) -> int:
    """Records sent over and over as datagrams, ``eps`` a second by deadlines from the start, so that delays are made up for; returns how many.

    Terminators are taken off. Without ``count`` it ends when ``stopped`` says so.
    """
    kept = [r.rstrip(b"\r\n") for r in records]
    kept = [r for r in kept if r]
    if not kept or eps <= 0:
        raise ValueError("nothing to send, or no rate to send it at")
    sent, began = 0, time.monotonic()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for record in itertools.cycle(kept):
            if count is not None and sent >= count or stopped():
                return sent
            if (wait := began + sent / eps - time.monotonic()) > 0:
                time.sleep(wait)
            s.sendto(record, (host, port))
            sent += 1
    return sent


class Simulators:
    """Replays that run side by side, by name."""

    def __init__(self) -> None:
        self._lock, self._running = threading.Lock(), {}

    def start(self, name: str, records: Iterable[bytes], host: str, port: int, eps: float) -> None:
        kept, stop, sent = list(records), threading.Event(), []
        thread = threading.Thread(target=lambda: sent.append(replay(kept, host, port, eps, stopped=stop.is_set)), daemon=True)
        with self._lock:
            if name in self._running:
                raise ValueError(f"{name} is running")
            self._running[name] = (thread, stop, sent)
        thread.start()

    def running(self) -> list[str]:
        with self._lock:
            return sorted(self._running)

    def stop(self, name: str) -> int:
        """Ends a replay; returns how many datagrams it sent."""
        with self._lock:
            thread, stop, sent = self._running.pop(name)
        stop.set()
        thread.join()
        return sent[0] if sent else 0
