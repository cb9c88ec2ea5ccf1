"""Per-period aggregates by event time under per-source low watermarks.

Every source (a receiver) punctuates its stream with its receipt clock: at clock ``t`` its low
watermark is ``t - lateness``. A period closes when every source has passed its end; a source
without a receipt for ``idle_s`` is timed out and holds nothing up. The close publishes the
period's first result. Receipts that come later are diverted: up to the cut-off they correct
the published result, step by step, beyond it they are refused. The clocks are reduced to one
row per source and period end before anything is shuffled, so neither a hot source nor a hot
period meets in one task.

The watermarks decide what is published at the close, what is diverted and when corrections
appear. The cut-off itself is an exact check on the diverted receipts: six hours after the end
of the hour, whatever the clocks of the sources say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timestamps import receipt_ns

NS = 1_000_000_000
HOUR_S = 3600
CUTOFF_S = 6 * HOUR_S
#: How far behind its receipt clock a source's watermark stays, and when a silent source is timed out.
LATENESS_S, IDLE_S = 1800, 900
#: Corrections of a published period appear at multiples of this after its close.
STEP_S = 900


def whole_seconds(ns: Column) -> Column:
    """Nanoseconds to the second they lie in, in integer arithmetic."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(NS)), F.lit(NS)).cast("bigint")


def period_start(ns: Column, period_s: int = HOUR_S) -> Column:
    """The period of an instant, as its start in epoch seconds (also before 1970)."""
    whole = whole_seconds(ns)
    return whole - F.pmod(whole, F.lit(period_s))


def close_instants(receipts: DataFrame, lateness_s: int, idle_s: int = IDLE_S, period_s: int = HOUR_S) -> DataFrame:
    """``(period_end, close_ns)`` of the periods whose closing a receipt decides.

    ``receipts`` has ``source`` and ``at_ns``. A source counts for a period if it was not idle
    when the end plus lateness was reached; it passes with its first receipt from then on, at
    the latest by the time-out. A period without a row closes at its end plus lateness, all
    sources being idle. Null clocks are ignored.
    """
    shifted, period = F.col("at_ns") - lateness_s * NS, period_s * NS
    since = F.pmod(shifted, F.lit(period))
    start = whole_seconds(shifted - since)
    after = F.when(since <= idle_s * NS, start)
    before = F.when(since == 0, start).when(period - since < idle_s * NS, start + period_s)
    ticks = (
        receipts.where(F.col("at_ns").isNotNull())
        .select("source", "at_ns", F.explode(F.array(F.struct(after.alias("end"), F.lit(True).alias("passed")), F.struct(before.alias("end"), F.lit(False).alias("passed")))).alias("t"))
        .where(F.col("t.end").isNotNull())
    )
    by_source = ticks.groupBy("source", F.col("t.end").alias("period_end")).agg(
        F.min(F.when(F.col("t.passed"), F.col("at_ns"))).alias("first_after"),
        F.max(~F.col("t.passed")).alias("was_active"),
    )
    timeout = (F.col("period_end") + lateness_s + idle_s) * NS
    return (
        by_source.where("was_active")
        .groupBy("period_end")
        .agg(F.max(F.coalesce(F.least("first_after", timeout), timeout)).alias("close_ns"))
    )


def arrivals(envelopes: DataFrame, features: DataFrame) -> DataFrame:
    """One row per event: ``event_uid, time_ns, pack_id, first_ns`` (earliest known receipt, null if none).

    Both tables meet in one aggregation by event, partly done before the shuffle; repeated rows
    collapse in it. Receipts without event or clock and events without features drop out of later steps.
    """
    seen = features.select("event_uid", "time_ns", "pack_id", F.lit(None).cast("bigint").alias("at_ns"))
    got = envelopes.where(F.col("event_uid").isNotNull() & F.col("received_at").isNotNull()).select(
        "event_uid", F.lit(None).cast("bigint").alias("time_ns"), F.lit(None).cast("string").alias("pack_id"), receipt_ns(F.col("received_at")).alias("at_ns")
    )
    return (
        seen.where(F.col("event_uid").isNotNull())
        .unionByName(got)
        .groupBy("event_uid")
        .agg(F.max("time_ns").alias("time_ns"), F.max("pack_id").alias("pack_id"), F.min("at_ns").alias("first_ns"))
    )


def judged(envelopes: DataFrame, features: DataFrame, lateness_s: int = LATENESS_S, cutoff_s: int = CUTOFF_S, idle_s: int = IDLE_S) -> DataFrame:
    """``arrivals`` with ``hour_start``, ``close_ns`` and ``outcome``: in_time, corrected or refused.

    An event that arrived before its hour was closed is in time. One that arrived later is
    diverted: it corrects the hour up to the cut-off and is refused beyond. A lateness and idle
    time-out beyond the cut-off are an error, for the close would come after it. Events of
    unknown time (null or -1) or without a known receipt have no row.
    """
    if lateness_s + idle_s > cutoff_s:
        raise ValueError("periods must be closed by the cut-off")
    receipts = envelopes.select(F.coalesce("receiver_id", F.lit("")).alias("source"), receipt_ns(F.col("received_at")).alias("at_ns"))
    closing = close_instants(receipts, lateness_s, idle_s)
    known = arrivals(envelopes, features).where(F.col("first_ns").isNotNull() & F.col("time_ns").isNotNull() & (F.col("time_ns") != -1))
    known = known.withColumn("hour_start", period_start(F.col("time_ns"))).withColumn("period_end", F.col("hour_start") + HOUR_S)
    # rows of closing: one per hour in which some source was active, whatever the number of events
    joined = known.join(closing, "period_end", "left").withColumn("close_ns", F.coalesce("close_ns", (F.col("period_end") + lateness_s) * NS))
    beyond = F.col("first_ns") > (F.col("period_end") + cutoff_s) * NS
    outcome = F.when(F.col("first_ns") <= F.col("close_ns"), "in_time").when(~beyond, "corrected").otherwise("refused")
    return joined.select("event_uid", "time_ns", "pack_id", "first_ns", "hour_start", "close_ns", outcome.alias("outcome"))


def diverted(envelopes: DataFrame, features: DataFrame, lateness_s: int = LATENESS_S) -> DataFrame:
    """``(event_uid, pack_id, hour_start, close_ns, first_ns, outcome)``: events that first arrived after their hour was closed."""
    return judged(envelopes, features, lateness_s).where(F.col("outcome") != "in_time").select("event_uid", "pack_id", "hour_start", "close_ns", "first_ns", "outcome")


def refused(envelopes: DataFrame, features: DataFrame) -> DataFrame:
    """``(event_uid, hour_start)`` of the diverted events that first arrived after the cut-off of their hour."""
    return diverted(envelopes, features).where(F.col("outcome") == "refused").select("event_uid", "hour_start")


def _count(*outcomes: str) -> Column:
    return F.count_if(F.col("outcome").isin(*outcomes))


def hourly(envelopes: DataFrame, features: DataFrame) -> DataFrame:
    """Events per hour and pack: as published at the close, as corrected up to the cut-off, diverted and refused."""
    return (
        judged(envelopes, features)
        .groupBy("hour_start", "pack_id")
        .agg(
            F.max("close_ns").alias("close_ns"),
            _count("in_time").alias("n_at_close"),
            _count("in_time", "corrected").alias("n_final"),
            _count("corrected", "refused").alias("n_diverted"),
            _count("refused").alias("n_refused"),
        )
    )


def corrections(envelopes: DataFrame, features: DataFrame, step_s: int = STEP_S) -> DataFrame:
    """The published results ``(hour_start, pack_id, published_ns, version, n_events)`` in order.

    Version 0 is the result at the close; each later version is the result after the diverted
    events of one step, a row only where the number changed. An hour and pack has at most
    ``1 + cutoff / step`` versions, so the running sum sorts a bounded group.
    """
    steps = F.ceil((F.col("first_ns") - F.col("close_ns")) / F.lit(step_s * NS))
    counted = (
        judged(envelopes, features)
        .where(F.col("outcome") != "refused")
        .groupBy("hour_start", "pack_id", "close_ns", F.when(F.col("outcome") == "in_time", F.lit(0).cast("bigint")).otherwise(steps).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = W.partitionBy("hour_start", "pack_id").orderBy("step")
    return counted.select(
        "hour_start",
        "pack_id",
        (F.col("close_ns") + F.col("step") * step_s * NS).alias("published_ns"),
        (F.row_number().over(order) - 1).alias("version"),
        F.sum("n").over(order).alias("n_events"),
    )
