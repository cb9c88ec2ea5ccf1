"""Exact distinct counts with bucketed, compressed bitmaps: zero error, mergeable partial results.

Addresses get dense integers from a stored dictionary, to which ids are only ever appended. A
set of them is cut into buckets of 65,536 ids; a bucket's container is a sorted list of 16-bit
offsets while it is sparse and a bitmap of 8 KB once it is dense. Partial results are rows
``(group, bucket, src, dst)`` of containers. Union (OR) and intersection (AND) work container by
container, so a hot group spreads over as many tasks as its set has buckets, and coarser
levels are merged from the containers of finer ones.

Results of two runs merge if both were coded with the same dictionary; its id goes with them,
and merging others is refused. Spark's own bitmap aggregates know only dense bitmaps of 4 KB,
one per group and bucket, which a sparse group would fill with zeros; containers are therefore
folded over Arrow batches, vectorised, while dictionary, joins, shuffles and counts stay in the JVM.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, scratch

DIMENSIONS = ("day", "pack_id", "class_uid")
_TYPES = {"day": ("int", pa.int32()), "pack_id": ("string", pa.string()), "class_uid": ("bigint", pa.int64())}
#: Ids of a bucket, bytes of a bitmap, and the most members of a list (shorter than a bitmap, so that the length tells them apart).
BUCKET_BITS = 16
BITMAP_BYTES = (1 << BUCKET_BITS) // 8
LIST_MAX = BITMAP_BYTES // 2 - 1


def occurrences(features: DataFrame) -> DataFrame:
    """``(day, pack_id, class_uid, address, sides)``, distinct: sides 1 source, 2 destination, 3 both.

    Empty and null addresses are left out; a null time has a null day.
    """
    day = F.expr("CAST(floor(epoch_seconds / 86400) AS INT)")
    sides = F.array(F.struct(F.col("src_ip").alias("address"), F.lit(1).alias("side")), F.struct(F.col("dst_ip").alias("address"), F.lit(2).alias("side")))
    return (
        features.select(day.alias("day"), "pack_id", "class_uid", F.inline(sides))
        .where(F.col("address") != "")
        .groupBy(*DIMENSIONS, "address")
        .agg(F.bit_or("side").alias("sides"))
    )


def by_address(occurring: DataFrame) -> DataFrame:
    """Occurrences written once, bucketed by address: numbering and coding need no further shuffle of them.

    They are distinct, so an address has at most one row per group, however hot it is.
    """
    spark = occurring.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"occurrences_{uuid.uuid4().hex}"
    path = scratch(spark, "occurrences", name)
    occurring.repartition(buckets, "address").write.bucketBy(buckets, "address").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


# --- the dictionary ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dictionary:
    """A version of a stored dictionary ``(address, id)``: ids are dense from 0 and never change.

    The folder holds one Parquet part per version and, written last, one manifest per version.
    A part without manifest is of an append that failed, and is not read; two appends at once
    can not both write the manifest of the same version, the later one fails.
    """

    spark: SparkSession
    path: str
    uid: str
    parts: tuple[str, ...]
    size: int

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None) -> Dictionary:
        """A new, empty dictionary at ``path``, in the session's shared folder if there is none given."""
        return cls(spark, path or scratch(spark, "dictionary"), uuid.uuid4().hex, (), 0)._commit()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Dictionary:
        """The latest version at ``path``."""
        fs, at = _files(spark, path)
        versions = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("version-"))
        got = json.loads(spark.read.text(f"{path}/{versions[-1]}", wholetext=True).first()[0])
        return cls(spark, path, got["uid"], tuple(got["parts"]), got["size"])

    def _commit(self) -> Dictionary:
        fs, at = _files(self.spark, f"{self.path}/version-{len(self.parts):06d}.json")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps({"uid": self.uid, "parts": self.parts, "size": self.size}).encode()))
        out.close()
        return self

    def table(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], "address string, id bigint")
        return self.spark.read.schema("address string, id bigint").parquet(*[f"{self.path}/{p}" for p in self.parts])

    def extended(self, occurring: DataFrame) -> Dictionary:
        """This dictionary with the addresses of ``occurring`` that it lacks, as a new version.

        New addresses are numbered where they are: a task's addresses get successive ids, those
        of most groups first, so that its containers are complete or nearly so before anything
        is shuffled. Only the number of addresses per task travels.
        """
        seen = occurring.groupBy("address").agg(F.count(F.lit(1)).alias("groups"))
        fresh = seen.join(self.table(), "address", "left_anti") if self.parts else seen
        # positions are written before they are read, so that a repeated task can not change them
        placed = cut(fresh.sortWithinPartitions(F.desc("groups"), "address").select("address", F.monotonically_increasing_id().alias("at")))
        task, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
        sizes = placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        offsets = sizes.select("task", (before + self.size).alias("offset"))  # one row per task
        part = f"part-{len(self.parts):06d}-{uuid.uuid4().hex}"
        placed.withColumn("task", task).join(F.broadcast(offsets), "task").select("address", (F.col("offset") + place).alias("id")).write.parquet(f"{self.path}/{part}")
        added = self.spark.read.parquet(f"{self.path}/{part}").count()
        return Dictionary(self.spark, self.path, self.uid, (*self.parts, part), self.size + added)._commit()


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


# --- containers --------------------------------------------------------------------------------------


def _bits_of(places: bytes) -> np.ndarray:
    """The bitmap of a list of any length."""
    bits = np.zeros(1 << BUCKET_BITS, np.uint8)
    bits[np.frombuffer(places, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


def to_bits(container: bytes) -> np.ndarray:
    """A container as a bitmap: the bytes of its bits, lowest first."""
    return np.frombuffer(container, np.uint8) if len(container) == BITMAP_BYTES else _bits_of(container)


def to_container(bits: np.ndarray) -> tuple[bytes, int]:
    """The container of a bitmap, and the number of its members."""
    n = int(np.bitwise_count(bits.view(np.uint64)).sum())
    if n > LIST_MAX:
        return bits.tobytes(), n
    return np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype("<u2").tobytes(), n


def _groups(keys: list[pa.Array]) -> np.ndarray:
    """The number of the group of each row: rows with equal keys that follow each other (nulls are equal)."""
    n = len(keys[0])
    changed = np.zeros(n, bool)
    for column in keys:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


def _members(column: pa.Array, group: np.ndarray, sparse: np.ndarray) -> np.ndarray:
    """``group << 16 | offset`` of the members of the list containers in rows of sparse groups."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    keep = np.repeat(sparse, lengths // 2)
    places = np.frombuffer(data.tobytes()[: len(data) // 2 * 2], "<u2").astype(np.int64)
    return (np.repeat(group, lengths // 2).astype(np.int64) << BUCKET_BITS | places)[keep]


def _sparse_column(codes: np.ndarray, n_groups: int) -> tuple[list[bytes], np.ndarray]:
    """The list containers of sorted distinct members, and their sizes."""
    sizes = np.bincount(codes >> BUCKET_BITS, minlength=n_groups)
    data = (codes & ((1 << BUCKET_BITS) - 1)).astype("<u2").tobytes()
    ends = np.cumsum(sizes) * 2
    return [data[e - 2 * s : e] for e, s in zip(ends.tolist(), sizes.tolist())], sizes


def _by_group(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of sorted rows, cut so that no group spans two, with the group of every row."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = (pa.concat_tables([held, now]) if held is not None else now).combine_chunks()
        group = _groups([now.column(i).combine_chunks() for i in range(n_keys)])
        last = int(np.searchsorted(group, group[-1]))
        held = now.slice(last)
        if last:
            yield now.slice(0, last), group[:last]
    if held is not None:
        held = held.combine_chunks()
        yield held, np.zeros(held.num_rows, np.int64)


def _pack(codes: np.ndarray, n_groups: int) -> tuple[list[bytes], np.ndarray]:
    """Containers of sorted distinct members, dense ones as bitmaps."""
    containers, sizes = _sparse_column(codes, n_groups)
    for g in np.flatnonzero(sizes > LIST_MAX):
        containers[g] = _bits_of(containers[g]).tobytes()
    return containers, sizes


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _fold(table: pa.Table, group: np.ndarray) -> dict[str, list]:
    """Containers and counts of every group of a table: the OR of its rows."""
    n_groups = int(group[-1]) + 1
    columns = {side: _column(table, side) for side in ("src", "dst")}
    lengths = {side: np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for side, c in columns.items()}
    # a group is sparse if its lists together can not fill a bitmap and none of its rows is one
    dense = np.zeros(n_groups, bool)
    for n in lengths.values():
        dense |= np.bincount(group, weights=n, minlength=n_groups) >= BITMAP_BYTES
    sparse = ~dense[group]
    codes = {side: np.unique(_members(c, group, sparse)) for side, c in columns.items()}
    out: dict[str, list] = {}
    for side in ("src", "dst"):
        containers, sizes = _sparse_column(codes[side], n_groups)
        out[side], out[f"n_{side}"] = containers, sizes.tolist()
    out["n_any"] = np.bincount(np.union1d(codes["src"], codes["dst"]) >> BUCKET_BITS, minlength=n_groups).tolist()
    for g in np.flatnonzero(dense):
        rows = np.flatnonzero(group == g)
        bits = {side: reduce(np.bitwise_or, (to_bits(columns[side][int(i)].as_py()) for i in rows)) for side in ("src", "dst")}
        for side in ("src", "dst"):
            out[side][g], out[f"n_{side}"][g] = to_container(bits[side])
        out["n_any"][g] = int(np.bitwise_count((bits["src"] | bits["dst"]).view(np.uint64)).sum())
    return out


_SETS = [("src", pa.binary(), "binary"), ("dst", pa.binary(), "binary"), ("n_src", pa.int32(), "int"), ("n_dst", pa.int32(), "int"), ("n_any", pa.int32(), "int")]


def _over_groups(df: DataFrame, by: tuple[str, ...], fold: Callable[[pa.Table, np.ndarray], dict[str, list]]) -> DataFrame:
    """``fold`` applied to the rows of every group and bucket, which must follow each other: one row of containers each."""
    keys = (*by, "bucket")
    types = {**{k: _TYPES[k] for k in by}, "bucket": ("bigint", pa.int64())}
    schema = ", ".join([f"{k} {types[k][0]}" for k in keys] + [f"{n} {t}" for n, _, t in _SETS])
    arrow = pa.schema([*[(k, types[k][1]) for k in keys], *[(n, t) for n, t, _ in _SETS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _by_group(batches, len(keys)):
            firsts = pa.array(np.flatnonzero(np.diff(group, prepend=-1)))
            folded = fold(table, group)
            made = [pa.array(folded[n], t) for n, t, _ in _SETS]
            yield pa.Table.from_arrays([*[table.column(k).take(firsts).combine_chunks().cast(types[k][1]) for k in keys], *made], schema=arrow).combine_chunks().to_batches()[0]

    return df.mapInArrow(run, schema)


def _coded(table: pa.Table, group: np.ndarray) -> dict[str, list]:
    """Containers of rows of single ids, ``place`` and ``sides``, sorted by place."""
    n_groups = int(group[-1]) + 1
    place, sides = _column(table, "place").to_numpy().astype(np.int64), _column(table, "sides").to_numpy()
    codes = group << BUCKET_BITS | place
    out: dict[str, list] = {}
    for side, bit in (("src", 1), ("dst", 2)):
        containers, sizes = _pack(codes[sides & bit != 0], n_groups)
        out[side], out[f"n_{side}"] = containers, sizes.tolist()
    out["n_any"] = np.bincount(group, minlength=n_groups).tolist()
    return out


# --- partial results ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Partials:
    """Containers ``(by..., bucket, src, dst, n_src, n_dst, n_any)``, and the dictionary that their ids are of.

    Several rows may hold parts of one group and bucket until they are merged.
    """

    rows: DataFrame
    by: tuple[str, ...]
    dictionary: str

    def union(self, other: Partials) -> Partials:
        """The partial results of two runs beside each other; refused if they were coded differently."""
        if self.dictionary != other.dictionary:
            raise ValueError(f"partial results of the dictionaries {self.dictionary} and {other.dictionary} can not be merged")
        if self.by != other.by:
            raise ValueError(f"partial results by {self.by} and by {other.by}")
        return Partials(self.rows.unionByName(other.rows), self.by, self.dictionary)

    def merged(self, *by: str) -> Partials:
        """Merged over every dimension but ``by``: the OR of the containers of each group and bucket."""
        keys = (*by, "bucket")
        rows = self.rows.select(*keys, "src", "dst").repartition(*keys).sortWithinPartitions(*keys)
        return Partials(_over_groups(rows, by, _fold), by, self.dictionary)

    def stored(self) -> Partials:
        """The same, written to the shared folder."""
        return Partials(cut(self.rows), self.by, self.dictionary)

    def overlap(self, other: Partials) -> Partials:
        """Of two merged results, the AND of the sets of each group: its sources in both and its destinations in both."""
        if self.dictionary != other.dictionary or self.by != other.by:
            raise ValueError("sets of different dictionaries or dimensions")
        keys = (*self.by, "bucket")
        tagged = self.rows.select(*keys, "src", "dst", F.lit(0).alias("which")).unionByName(other.rows.select(*keys, "src", "dst", F.lit(1).alias("which")))
        return Partials(_over_groups(tagged.repartition(*keys).sortWithinPartitions(*keys), self.by, _both), self.by, self.dictionary)

    def counts(self) -> DataFrame:
        """Members per group, of merged results: sources, destinations and either, with the error bound."""
        total = lambda c, name: F.sum(c).cast("bigint").alias(name)
        return self.rows.groupBy(*self.by).agg(total("n_src", "n_src_ip"), total("n_dst", "n_dst_ip"), total("n_any", "n_ip"), F.lit(0).cast("bigint").alias("error_bound"))


def _and(a: bytes, b: bytes) -> tuple[bytes, int]:
    if len(a) == len(b) == BITMAP_BYTES:
        return to_container(to_bits(a) & to_bits(b))
    if BITMAP_BYTES in (len(a), len(b)):
        bits, places = (to_bits(a), np.frombuffer(b, "<u2")) if len(a) == BITMAP_BYTES else (to_bits(b), np.frombuffer(a, "<u2"))
        both = places[bits[places >> 3] >> (places & 7) & 1 != 0]
    else:
        both = np.intersect1d(np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2"), assume_unique=True)
    return both.tobytes(), len(both)


def _both(table: pa.Table, group: np.ndarray) -> dict[str, list]:
    """The AND of the two rows of every group; empty where there is one."""
    n_groups = int(group[-1]) + 1
    first = np.flatnonzero(np.diff(group, prepend=-1))
    out: dict[str, list] = {"src": [b""] * n_groups, "dst": [b""] * n_groups, "n_src": [0] * n_groups, "n_dst": [0] * n_groups, "n_any": [0] * n_groups}
    columns = {side: _column(table, side) for side in ("src", "dst")}
    for g in np.flatnonzero(np.bincount(group, minlength=n_groups) == 2):
        i = int(first[g])
        for side, column in columns.items():
            out[side][g], out[f"n_{side}"][g] = _and(column[i].as_py(), column[i + 1].as_py())
        out["n_any"][g] = int(np.bitwise_count((to_bits(out["src"][g]) | to_bits(out["dst"][g])).view(np.uint64)).sum())
    return out


def bitmaps(features: DataFrame, dictionary: Dictionary | None = None) -> tuple[Partials, Dictionary]:
    """The partial results of ``features`` by day, pack and class, and the dictionary with its addresses added.

    Give the dictionary of an earlier run to get results that merge with that run's. An empty
    table gives no rows.
    """
    seen = by_address(occurrences(features))
    dictionary = (dictionary or Dictionary.create(features.sparkSession)).extended(seen)
    bucket, place = F.shiftright("id", BUCKET_BITS), F.col("id").bitwiseAND((1 << BUCKET_BITS) - 1).cast("int")
    # joined by merge: the written side stays in its buckets, and a broadcast would depend on the number of addresses
    coded = seen.join(dictionary.table().hint("merge"), "address").select(*DIMENSIONS, bucket.alias("bucket"), place.alias("place"), "sides")
    coded = coded.sortWithinPartitions(*DIMENSIONS, "bucket", "place")
    return Partials(_over_groups(coded, DIMENSIONS, _coded), DIMENSIONS, dictionary.uid), dictionary


def levels(parts: Partials) -> DataFrame:
    """Counts per day, pack and class and every combination of them, coarser levels from finer ones.

    ``level`` names the dimensions that a row is for (``all``: none); the others are null in it.
    Groups without any address have no row.
    """
    finest = parts.merged(*DIMENSIONS).stored()
    days_packs, packs_classes = finest.merged("day", "pack_id").stored(), finest.merged("pack_id", "class_uid").stored()
    days = days_packs.merged("day").stored()
    chain = [finest, days_packs, finest.merged("day", "class_uid"), packs_classes, days, packs_classes.merged("pack_id"), packs_classes.merged("class_uid"), days.merged()]
    out = []
    for p in chain:
        dims = [(F.col(c) if c in p.by else F.lit(None).cast(_TYPES[c][0])).alias(c) for c in DIMENSIONS]
        out.append(p.counts().select(F.lit("+".join(p.by) or "all").alias("level"), *dims, "n_src_ip", "n_dst_ip", "n_ip", "error_bound"))
    return reduce(DataFrame.unionByName, out).where(F.col("n_ip") > 0)


def cube(features: DataFrame) -> DataFrame:
    """Distinct addresses per day, pack and class and every combination of them; see ``levels``."""
    return levels(bitmaps(features)[0])


def cube_of_runs(runs: list[DataFrame]) -> DataFrame:
    """The same from several runs: each extends the dictionary and leaves partial results, which then merge."""
    dictionary, parts = None, None
    for run in runs:
        got, dictionary = bitmaps(run, dictionary)
        parts = got if parts is None else parts.union(got)
    return levels(parts)


def returning(features: DataFrame) -> DataFrame:
    """``(day, n_src_ip, n_dst_ip)``: sources of a day that were sources on the day before too, and likewise destinations."""
    days = bitmaps(features)[0].merged("day").stored()
    known = Partials(days.rows.where("day is not null"), days.by, days.dictionary)
    before = Partials(known.rows.withColumn("day", F.col("day") + 1), days.by, days.dictionary)
    return known.overlap(before).counts().where("n_ip > 0").select("day", "n_src_ip", "n_dst_ip")
