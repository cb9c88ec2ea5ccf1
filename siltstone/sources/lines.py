"""Sources: files of lines with their terminators, lists of lines, NDJSON events, the vault."""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch

MAX_INGEST_LINES, MAX_INGEST_BYTES = 2000, 4 << 20
#: Bytes of a file that one task reads, and lines and bytes that it hands on at once.
SPLIT_BYTES, BATCH_LINES, BATCH_BYTES = 64 << 20, 10_000, 8 << 20
RECORD = "raw binary, received_at bigint, peer string, transport string, receiver_id string, origin string, locator string"


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Address and size of the files of a path, which may be a file, a folder or a pattern; hidden ones left out."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, out = [*(fs.globStatus(at) or [])], []
    if not found:
        raise FileNotFoundError(path)
    while found:
        status = found.pop()
        if status.isDirectory():
            found += [s for s in fs.listStatus(status.getPath()) if s.getPath().getName()[:1] not in "._"]
        else:
            out.append((status.getPath().toString(), status.getLen()))
    return sorted(out)


def _open(address: str):
    from pyarrow import fs

    if address.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + address[5:].lstrip("/"))
    files, where = fs.FileSystem.from_uri(address)
    return files.open_input_file(where)


def lines_between(file, start: int, end: int, size: int):
    """``(offset, line)`` of the lines that begin from ``start`` to before ``end``, each with its LF if it has one."""
    chunk, held, at = 1 << 20, b"", start
    if start:
        # a line begins here only if the byte before ends one
        file.seek(start - 1)
        while True:
            found = file.read(chunk)
            cut = found.find(b"\n")
            if cut >= 0 or not found:
                held = found[cut + 1 :] if cut >= 0 else b""
                at = file.tell() - len(held)
                break
    else:
        file.seek(0)
    parts = [held] if held else []
    while at < end and at < size:
        text = b"".join(parts)
        cut = text.find(b"\n")
        while cut < 0:
            more = file.read(chunk)
            if not more:
                break
            parts.append(more)
            cut = more.find(b"\n")
            if cut >= 0:
                cut += sum(map(len, parts[:-1]))
        text = b"".join(parts)
        begin = 0
        while cut >= 0 and at < end:
            yield at, text[begin : cut + 1]
            at, begin = at + cut + 1 - begin, cut + 1
            cut = text.find(b"\n", begin)
        if cut < 0 and at < end and file.tell() >= size:
            if begin < len(text):
                yield at, text[begin:]
            return
        parts = [text[begin:]]


def read_lines(spark: SparkSession, path: str, receiver: str = "cli", received_at: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Files as records ``raw``: every line with the LF that ended it, byte for byte, blank lines included.

    A last line without LF has none. origin is the file, locator the file and the line's
    offset, so that equal lines are different records with different events. Large files are
    read by several tasks, from any storage that Arrow opens. An empty file has no records.
    """
    splits = [(address, start, min(start + split_bytes, size), size) for address, size in _files(spark, path) for start in range(0, size, split_bytes)]
    schema = pa.schema([("raw", pa.binary()), ("received_at", pa.int64()), ("peer", pa.string()), ("transport", pa.string()), ("receiver_id", pa.string()), ("origin", pa.string()), ("locator", pa.string())])

    def made(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        n = len(rows)
        columns = [[r[2] for r in rows], [received_at] * n, [None] * n, ["file"] * n, [receiver] * n, [r[0] for r in rows], [f"file:{r[1]:016x}:{len(r[2]):08x}:{r[0]}" for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        for batch in batches:
            for split in batch.to_pylist():
                rows, held = [], 0
                with _open(split["address"]) as file:
                    for offset, line in lines_between(file, split["start"], split["upto"], split["size"]):
                        rows.append((split["address"], offset, line))
                        held += len(line)
                        if len(rows) >= BATCH_LINES or held >= BATCH_BYTES:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    listed = spark.createDataFrame(splits, "address string, start bigint, upto bigint, size bigint")
    return listed.repartition(max(1, min(len(splits), 10_000))).mapInArrow(run, RECORD)


def read_stdin(spark: SparkSession, stream=None, receiver: str = "stdin", received_at: int = 0) -> DataFrame:
    """A byte stream as records, like a file: it is written to the shared folder piece by piece, and read from there."""
    path = f"{scratch(spark, 'stdin')}/lines"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    stream = stream or sys.stdin.buffer
    while piece := stream.read(1 << 20):
        out.write(bytearray(piece))
    out.close()
    return read_lines(spark, path, receiver, received_at).withColumn("transport", F.lit("stdin")).withColumn("origin", F.lit(None).cast("string"))


def ingest_lines(spark: SparkSession, lines: list[str], receiver: str = "console", received_at: int = 0) -> DataFrame:
    """A list of lines as records without terminators; blank ones are skipped. At most 2,000 lines and 4 MiB."""
    kept = [(i, x) for i, x in enumerate(lines) if x.strip()]
    if len(kept) > MAX_INGEST_LINES or sum(len(x.encode("utf-8", "surrogateescape")) for _, x in kept) > MAX_INGEST_BYTES:
        raise ValueError("too many lines at once")
    batch = uuid.uuid4().hex
    rows = [(bytearray(x.encode("utf-8", "surrogateescape")), received_at, None, "http", receiver, None, f"http:{batch}:{i:08x}") for i, x in kept]
    return spark.createDataFrame(rows, RECORD)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON events as ``event_json`` text, blank lines skipped; the text is kept as written, for hashing."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("event_json"), F.get_json_object("value", "$.metadata.uid").alias("event_uid"))


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    schema = "raw_text string, raw_encoding string, raw_hex string, disposition string, pack string, locator string, received_at bigint"
    return spark.read.schema(schema).json(path).where(F.col("raw_text").isNotNull())


def recent(events: DataFrame, order: str = "seq", limit: int = 200) -> DataFrame:
    """The newest events, newest first: a top-k report of at least 1 and at most 500."""
    return events.orderBy(F.desc(order)).limit(max(1, min(500, limit)))


def read_vault(spark: SparkSession, path: str, key: bytes | None = None) -> DataFrame:
    """All records of a vault; ``intact`` is false where length or checksum do not hold, and the bytes are then null."""
    stored = spark.read.parquet(path).withColumn("segment", F.col("segment").cast("bigint"))
    raw = F.col("raw") if key is None else F.try_aes_decrypt("raw", F.lit(key), F.lit("GCM"))
    opened = stored.withColumn("_raw", raw)
    intact = F.coalesce((F.crc32("_raw") == F.col("crc32")) & (F.octet_length("_raw") == F.col("len")), F.lit(False))
    return opened.withColumn("intact", intact).withColumn("raw", F.when(F.col("intact"), F.col("_raw"))).drop("_raw")


def unseal(spark: SparkSession, path: str) -> DataFrame:
    """The index of a vault, as its segments were sealed with, and rebuilt by a scan for segments without a seal.

    A rebuilt segment ends before its first gap or damaged record: what follows was not
    written whole. ``sealed`` says which it is. The running end is taken within blocks of
    offsets, so that a segment of any size is not sorted in one task.
    """
    from ..session import table_exists

    stored = read_vault(spark, path).select("segment", "offset", "len", "crc32", "locator", "intact")
    columns = ["segment", "offset", "len", "crc32", "locator"]
    known = spark.read.parquet(f"{path}-index") if table_exists(spark, f"{path}-index") else stored.select(*columns).limit(0)
    open_ = stored.join(known.select("segment").distinct(), "segment", "left_anti")
    block = F.floor(F.col("offset") / (1 << 24))
    ends = open_.groupBy("segment", block.alias("_block")).agg(F.max(F.col("offset") + F.col("len")).alias("_end"))
    carried = ends.select("segment", "_block", F.max("_end").over(W.partitionBy("segment").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    within = W.partitionBy("segment", "_block").orderBy("offset", "len").rowsBetween(W.unboundedPreceding, -1)
    placed = open_.withColumn("_block", block).withColumn("_own", F.max(F.col("offset") + F.col("len")).over(within)).join(carried, ["segment", "_block"])
    before = F.greatest(F.coalesce("_own", F.lit(0)), F.coalesce("_carried", F.lit(0)))
    marked = placed.withColumn("_bad", ~F.col("intact") | (F.col("offset") != before))
    stop = marked.where("_bad").groupBy("segment").agg(F.min("offset").alias("_stop"))  # one row per segment
    whole = marked.join(stop, "segment", "left").where(F.col("_stop").isNull() | (F.col("offset") < F.col("_stop"))).select(*columns)
    return known.select(*columns, F.lit(True).alias("sealed")).unionByName(whole.withColumn("sealed", F.lit(False)))


def lookup(vault: DataFrame, locator: str) -> bytes:
    """The bytes at a locator, never others: a wrong, missing or damaged record is an error."""
    parts = locator.split(":")
    if len(parts) != 5:
        raise ValueError("no locator")
    segment, offset, length = (int(p, 16) for p in parts[2:])
    row = vault.where((F.col("segment") == segment) & (F.col("offset") == offset) & (F.col("len") == length)).select("raw", "intact").head()
    if row is None or not row.intact:
        raise LookupError(f"{locator}: no such intact record")
    return bytes(row.raw)
