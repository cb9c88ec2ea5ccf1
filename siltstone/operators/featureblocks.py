"""One row per entity from events, by blocks of event types.

Events are counted once each, then aggregated by entity and event type (partly before the
shuffle, which also levels hot entities). The types are partitioned into blocks; the aggregate
is written once to the shared folder, partitioned by block and bucketed by entity. Each block
is then read alone, folded to one row per entity and joined, bucket by bucket and without a
further shuffle, onto the complete entity table.

A block column lists the types that occur, so a row is as long as what the entity did and not
as the catalogue of types; an absent type has count 0. ``widen`` gives flat columns, one set
for each type asked for, ``catalogue`` the types there are.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

N_BLOCKS = 8


def event_types(features: DataFrame) -> DataFrame:
    """``(src_ip, class_uid, severity_id, n, last_time_ns, severity_total)``, each event_uid counted once.

    Of differing rows of an event the least (source, class, severity, time) counts. Events
    without source address (null or empty) have no row; events without uid count each.
    """
    fields = ("src_ip", "class_uid", "severity_id", "time_ns")
    named = features.where(F.col("src_ip") != "").select("event_uid", *fields)
    once = named.where(F.col("event_uid").isNotNull()).groupBy("event_uid").agg(F.min(F.struct(*fields)).alias("e")).select("e.*")
    anonymous = named.where(F.col("event_uid").isNull()).select(*fields)
    return once.unionByName(anonymous).groupBy("src_ip", "class_uid", "severity_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("time_ns").alias("last_time_ns"), F.coalesce(F.sum("severity_id"), F.lit(0)).alias("severity_total")
    )


def block_of(class_uid: int) -> int:
    """The block of a class: of its category, which is its number without the last three digits (towards zero, as SQL ``div``)."""
    return abs(class_uid) // 1000 * (1 if class_uid >= 0 else -1) % N_BLOCKS


def bucketed(types: DataFrame, buckets: int) -> DataFrame:
    """``types`` as a table in the shared folder, partitioned by block and bucketed by entity."""
    spark = types.sparkSession
    name = f"entity_types_{uuid.uuid4().hex}"
    block = F.coalesce(F.pmod(F.expr("class_uid div 1000"), F.lit(N_BLOCKS)), F.lit(0)).cast("int")
    path = scratch(spark, "entity-types", name)
    (
        types.withColumn("block", block)
        .repartition(buckets, "src_ip")
        .write.partitionBy("block")
        .bucketBy(buckets, "src_ip")
        .option("path", path)
        .format("parquet")
        .saveAsTable(name)
    )
    return spark.table(name)


def entity_features(features: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per non-empty src_ip: overall count, last time and total, and ``block_0`` to ``block_7``.

    Each block is an array of ``(class_uid, severity_id, n, last_time_ns, severity_total)`` by
    class and severity, empty where the entity has none of its types. An empty table gives no rows.
    """
    spark = features.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = bucketed(event_types(features), buckets)
    entities = stored.groupBy("src_ip").agg(
        F.sum("n").alias("n"), F.max("last_time_ns").alias("last_time_ns"), F.sum("severity_total").alias("severity_total")
    )
    one = F.struct("class_uid", "severity_id", "n", "last_time_ns", "severity_total")
    blocks = [
        stored.where(F.col("block") == k).groupBy("src_ip").agg(F.array_sort(F.collect_list(one)).alias(f"block_{k}")) for k in range(N_BLOCKS)
    ]
    # merge keeps both sides in their buckets; a broadcast would depend on the number of entities
    joined = reduce(lambda left, right: left.join(right.hint("merge"), "src_ip", "left"), blocks, entities)
    none = F.array().cast("array<struct<class_uid:bigint,severity_id:bigint,n:bigint,last_time_ns:bigint,severity_total:bigint>>")
    return joined.select("src_ip", "n", "last_time_ns", "severity_total", *[F.coalesce(f"block_{k}", none).alias(f"block_{k}") for k in range(N_BLOCKS)])


def listed(wide: DataFrame) -> DataFrame:
    """The block columns as rows ``(src_ip, class_uid, severity_id, n, last_time_ns, severity_total)``."""
    return wide.select("src_ip", F.inline(F.concat(*[F.col(f"block_{k}") for k in range(N_BLOCKS)])))


def catalogue(wide: DataFrame, most: int = 2000) -> list[tuple[int, int]]:
    """The ``(class_uid, severity_id)`` that occur, in order; more than ``most`` are an error, for they become columns."""
    types = listed(wide).where("class_uid is not null and severity_id is not null").select("class_uid", "severity_id").distinct().limit(most + 1).collect()
    if len(types) > most:
        raise ValueError(f"more than {most} event types")
    return sorted((t.class_uid, t.severity_id) for t in types)


def _of_type(block: Column, class_uid: int, severity_id: int) -> Column:
    hit = F.filter(block, lambda t: (t["class_uid"] == class_uid) & (t["severity_id"] == severity_id))
    return F.get(hit, F.lit(0))


def widen(wide: DataFrame, types: list[tuple[int, int]]) -> DataFrame:
    """Flat columns ``n_<class>_<severity>``, ``last_…`` and ``total_…`` of the given types; absent: 0, null, 0.

    A minus sign is ``m`` in a name: the type (-1, -1) has ``n_m1_m1``.
    """
    out = [F.col("src_ip")]
    for c, s in types:
        first = _of_type(F.col(f"block_{block_of(c)}"), c, s)
        name = f"{c}_{s}".replace("-", "m")
        out += [F.coalesce(first["n"], F.lit(0)).alias(f"n_{name}"), first["last_time_ns"].alias(f"last_{name}"), F.coalesce(first["severity_total"], F.lit(0)).alias(f"total_{name}")]
    return wide.select(*out)
