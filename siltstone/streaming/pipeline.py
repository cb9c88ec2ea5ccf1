"""The pipeline as a stream: files or datagrams in, events out, packs re-read for every micro-batch."""

from __future__ import annotations

import socket
import sqlite3
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.fused import normalise
from ..packs.spec import LIBRARY, load_library


def file_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """New files of a folder as records, line by line with their LF."""
    text = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(folder)
    return text.select(F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("raw"), F.lit("file").alias("transport"), (F.unix_micros(F.current_timestamp()) * 1000).alias("received_at"))


class UdpReader(SimpleDataSourceStreamReader):
    """Datagrams received by a thread of the driver; one datagram is one record.

    They are numbered and kept in a spool, a database file if the option ``spool`` names one,
    from which they are deleted once committed: after a restart what was not committed is read
    again, and numbers go on from the checkpoint's. Without a spool they are kept in memory,
    and lost with the driver. At most ``most`` (1,000,000) wait; further ones are dropped, as
    the network would, and counted.
    """

    GROUP, WAIT_S = 500, 0.05

    def __init__(self, options) -> None:
        self.lock, self.dropped = threading.Lock(), 0
        self.most = int(options.get("most", "1000000"))
        self.db = sqlite3.connect(options.get("spool", ":memory:"), check_same_thread=False)
        self.db.execute("CREATE TABLE IF NOT EXISTS record (n INTEGER PRIMARY KEY, data BLOB, received_at INTEGER, peer TEXT)")
        self.db.commit()
        self.next = (self.db.execute("SELECT max(n) FROM record").fetchone()[0] or -1) + 1
        self.based = self.next > 0
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 8 << 20)
        self.socket.bind((options.get("host", "0.0.0.0"), int(options.get("port", "5514"))))
        self.socket.settimeout(self.WAIT_S)
        threading.Thread(target=self._listen, daemon=True).start()

    def _listen(self) -> None:
        waiting: list[tuple] = []
        while True:
            try:
                data, (peer, *_) = self.socket.recvfrom(65_535)
                waiting.append((data, time.time_ns(), peer))
                if len(waiting) < self.GROUP:
                    continue
            except TimeoutError:
                pass
            except OSError:
                return
            if waiting:
                self.keep(waiting)
                waiting = []

    def keep(self, records: list[tuple]) -> None:
        with self.lock:
            room = self.most - self.db.execute("SELECT count(*) FROM record").fetchone()[0]
            self.dropped += max(0, len(records) - room)
            kept = records[: max(0, room)]
            self.db.executemany("INSERT INTO record VALUES (?, ?, ?, ?)", [(self.next + i, *r) for i, r in enumerate(kept)])
            self.db.commit()
            self.next += len(kept)

    def _from(self, start: int) -> None:
        """Numbers go on from the checkpoint's; what came before the first read is moved behind it."""
        if not self.based and start:
            self.db.execute("UPDATE record SET n = -1 - n")
            self.db.execute("UPDATE record SET n = ? - 1 - n", (start,))
            self.db.commit()
            self.next += start
        self.based = True

    def _rows(self, start: int, end: int) -> list[tuple]:
        found = self.db.execute("SELECT data, received_at, peer FROM record WHERE n >= ? AND n < ? ORDER BY n", (start, end))
        return [(bytearray(data), at, peer, "syslog_udp") for data, at, peer in found]

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        with self.lock:
            self._from(start["n"])
            end = max(self.next, start["n"])
            return iter(self._rows(start["n"], end)), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        with self.lock:
            self._from(end["n"])
            return iter(self._rows(start["n"], end["n"]))

    def commit(self, end: dict) -> None:
        with self.lock:
            self.db.execute("DELETE FROM record WHERE n < ?", (end["n"],))
            self.db.commit()


class UdpSource(DataSource):
    """``spark.readStream.format("udp_records")`` with options host and port."""

    @classmethod
    def name(cls) -> str:
        return "udp_records"

    def schema(self) -> str:
        return "raw binary, received_at bigint, peer string, transport string"

    def simpleStreamReader(self, schema):
        return UdpReader(self.options)


def start(raw: DataFrame, out: str, checkpoint: str, year: int, packs: str = LIBRARY, **trigger):
    """Runs the pipeline on a stream of records into Parquet; an unusable pack folder keeps the packs in use."""
    held: dict = {"packs": load_library(packs)[0]}

    def batch(df: DataFrame, number: int) -> None:
        fresh, _ = load_library(packs)
        held["packs"] = fresh or held["packs"]
        # the batch number in the path makes a repeated batch overwrite itself
        normalise(df, held["packs"], year).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly_stream(receipts: DataFrame, lateness: str = "6 hours") -> DataFrame:
    """Events per hour of event time and pack, corrected until the stream's own watermark has passed.

    ``receipts`` streams ``time_ns`` and ``pack_id``. A stream has one watermark, the latest
    time seen less ``lateness``, and rows behind it vanish; clocks per source, and a table of
    the diverted events, are what ``operators.watermark`` has.
    """
    at = F.timestamp_micros(F.call_function("div", F.col("time_ns"), F.lit(1000)))
    return receipts.where(F.col("time_ns") != -1).withColumn("at", at).withWatermark("at", lateness).groupBy(F.window("at", "1 hour").alias("w"), "pack_id").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("hour_start"), "pack_id", "n")
