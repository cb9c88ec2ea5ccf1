"""Entries from records: the records of one stream between two heads belong to one entry.

A head is a record with an event; a record without one continues the last head of its stream.
Finding that head is a forward fill over the stream in order of arrival. A stream may hold a
third of all rows, so the fill never sorts a whole stream in one task: arrival numbers are cut
into blocks of fixed width, the fill runs within ``(stream, block)``, and a small table with
the last head of every block carries the value over block borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a block in arrival numbers: the most rows that one window sorts at once.
BLOCK = 1 << 16


def stream_of(peer: str = "peer", origin: str = "origin") -> Column:
    return F.coalesce(F.col(peer), F.col(origin), F.lit(""))


def with_head(raw: DataFrame, block: int = BLOCK) -> DataFrame:
    """``raw`` with ``head_id``: the raw_id of the head of its entry.

    Continuing records before any head of their stream have the first record of their block as
    head, so that they form entries without an event, of bounded size, and nothing is lost.
    """
    df = raw.withColumn("_stream", stream_of()).withColumn("_block", F.floor(F.col("raw_id") / block))
    is_head = F.col("event_uid").isNotNull()
    last = df.groupBy("_stream", "_block").agg(
        F.max(F.when(is_head, F.col("raw_id"))).alias("_last"), F.min("raw_id").alias("_first")
    )
    before = W.partitionBy("_stream").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(
        "_stream", "_block", F.max("_last").over(before).alias("_carried"), F.col("_first").alias("_orphan")
    )
    within = W.partitionBy("_stream", "_block").orderBy("raw_id").rowsBetween(W.unboundedPreceding, 0)
    filled = df.withColumn("_own", F.max(F.when(is_head, F.col("raw_id"))).over(within))
    return (
        filled.join(carry, ["_stream", "_block"], "left")
        .withColumn("head_id", F.coalesce("_own", "_carried", "_orphan"))
        .drop("_block", "_own", "_carried", "_orphan")
    )


def n_lines(text: Column) -> Column:
    """Physical lines of a text: every terminator (LF, CRLF or CR) ends one; an unended rest is one more; at least one."""
    ends = F.length(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[^\n]+", ""))
    return F.greatest(ends + F.when(text.rlike(r"[^\r\n]\z"), 1).otherwise(0), F.lit(1))


def as_text(raw: Column) -> Column:
    """Bytes as text: UTF-8, bytes that are not UTF-8 replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def assemble(raw: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per entry: ``raw_id, locator, event_uid, peer, origin, received_at, text, n_lines``.

    The first record names the entry. Records are joined in order of arrival; a record without
    terminator still ends its line. Null bytes count as empty. An entry that was read twice is
    two entries, having two heads.
    """
    df = with_head(
        raw.select("raw_id", "locator", "event_uid", F.coalesce("raw", F.lit(b"")).alias("raw"), "received_at", "peer", "origin"), block
    )
    text = as_text(F.col("raw"))
    part = F.struct(
        "raw_id",
        F.when(text.rlike(r"[\r\n]\z"), text).otherwise(F.concat(text, F.lit("\n"))).alias("closed"),
        text.alias("text"),
    )
    first = lambda c: F.min_by(c, "raw_id").alias(c)
    grouped = df.groupBy("_stream", "head_id").agg(
        first("locator"), first("event_uid"), first("peer"), first("origin"), first("received_at"),
        F.sum(n_lines(text)).cast("int").alias("n_lines"),
        F.array_sort(F.collect_list(part)).alias("_parts"),
    )
    last = F.element_at("_parts", -1)["text"]
    front = F.transform(F.slice("_parts", 1, F.size("_parts") - 1), lambda p: p["closed"])
    return grouped.select(
        F.col("head_id").alias("raw_id"), "locator", "event_uid", "peer", "origin", "received_at",
        F.concat(F.array_join(front, ""), last).alias("text"), "n_lines",
    )
