"""Clusters of lines that share a shape: templates that generalise as lines arrive.

A line joins the most similar template of its token count, whose tokens it differs in become
wildcards; one that is like none becomes a template. The result depends on the order of
arrival, so one stream would have to pass through one task. Here the distinct token sequences
are spread over all tasks, each of which clusters its share in order of arrival; the templates
of all shares, which are few, are then clustered in the same way. ``exact`` streams the
sequences of one token count through one task instead, for the same result whatever the partitions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WILD = "<*>"
SIMILARITY = 0.4
#: Fixed value: lines kept of a cluster.
MAX_SAMPLES = 30


def tokenize(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s|,;]+"), lambda t: t != "")


class Templates:
    """Templates of one token count, as a matrix of numbered tokens: 0 is the wildcard, -1 a token that no template has."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {WILD: 0}
        self.matrix: np.ndarray | None = None
        self.clusters: list[dict] = []

    def best(self, row: np.ndarray) -> int | None:
        """The most similar template, the first of equals. A template of two literals and more keeps at least two."""
        if not self.clusters:
            return None
        known = self.matrix[: len(self.clusters)]
        literal = known != 0
        equal = literal & (known == row)
        same = (~literal | (row == 0) | equal).sum(axis=1)
        fits = (same >= SIMILARITY * len(row)) & ((literal.sum(axis=1) < 2) | (equal.sum(axis=1) >= 2))
        best = int(np.argmax(np.where(fits, same, -1)))
        return best if fits[best] else None

    def add(self, tokens: list[str], first: int, count: int, samples: list[str]) -> int:
        """The index of the cluster that ``count`` lines of these tokens join or found."""
        row = np.array([self.numbers.get(t, -1) for t in tokens], np.int64)
        at = self.best(row)
        if at is None:
            at = len(self.clusters)
            row = np.array([self.numbers.setdefault(t, len(self.numbers)) for t in tokens], np.int64)
            if self.matrix is None:
                self.matrix = np.zeros((16, len(tokens)), np.int64)
            elif at == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[at] = row
            self.clusters.append({"template": list(tokens), "n": count, "first_seq": first, "samples": samples[:MAX_SAMPLES]})
            return at
        cluster = self.clusters[at]
        for i in np.flatnonzero(self.matrix[at] != row):
            self.matrix[at, i] = 0
            cluster["template"][i] = WILD
        cluster["n"] += count
        cluster["samples"] += samples[: MAX_SAMPLES - len(cluster["samples"])]
        return at


CLUSTERS = "n_tokens int, first_seq bigint, template array<string>, n bigint, samples array<string>"
_ARROW = pa.schema([("n_tokens", pa.int32()), ("first_seq", pa.int64()), ("template", pa.list_(pa.string())), ("n", pa.int64()), ("samples", pa.list_(pa.string()))])


def _clustered(batches):
    """Rows of CLUSTERS, sorted by token count and arrival, to the clusters of every token count."""
    size, templates = None, Templates()
    done = lambda: [c | {"n_tokens": size} for c in templates.clusters]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["n_tokens"] != size:
                out += done()
                size, templates = row["n_tokens"], Templates()
            templates.add(row["template"], row["first_seq"], row["n"], row["samples"] or [])
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
    yield pa.RecordBatch.from_pylist(done(), schema=_ARROW)


def cluster(lines: DataFrame, text: str = "text", seq: str = "seq", cap: int | None = None, exact: bool = False) -> DataFrame:
    """``(cluster_id, n_tokens, first_seq, template, n, samples, specificity)``, by volume, ties by id.

    Equal token sequences are counted before they meet. Every line has a cluster, unless
    ``cap`` says how many there may be over all token counts: the first in order of creation
    are kept, and the lines of the others counted in a row without template. Blank and null
    lines have no cluster. Ids follow the order of creation.
    """
    tokens = tokenize(F.col(text))
    distinct = (
        lines.where(F.size(tokens) > 0)
        .select(tokens.alias("template"), F.col(seq).cast("bigint").alias("seq"), F.col(text).alias("line"))
        .groupBy("template")
        .agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"), F.array(F.min_by("line", "seq")).alias("samples"))
        .select(F.size("template").alias("n_tokens"), "first_seq", "template", "n", "samples")
    )
    order = ("n_tokens", "first_seq")
    if not exact:
        # the aggregation has spread them by their hash, whatever the token counts
        distinct = distinct.sortWithinPartitions(*order).mapInArrow(_clustered, CLUSTERS)
    found = distinct.repartition("n_tokens").sortWithinPartitions(*order).mapInArrow(_clustered, CLUSTERS)
    # one row per cluster: a small table
    nth = F.row_number().over(W.orderBy("first_seq", "n_tokens"))
    named = found.withColumn("nth", nth).withColumn("cluster_id", F.format_string("C%04d", "nth"))
    specificity = F.coalesce(F.size(F.filter("template", lambda t: t != WILD)) / F.size("template"), F.lit(0.0))
    columns = ["cluster_id", "n_tokens", "first_seq", "template", "n", "samples"]
    kept = named.select("nth", *columns)
    if cap is not None:
        beyond = kept.where(F.col("nth") > cap).agg(F.sum("n").alias("n")).where("n is not null")
        overflow = beyond.select(F.lit("overflow").alias("cluster_id"), *[F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in ("n_tokens", "first_seq", "template")], "n", F.array().cast("array<string>").alias("samples"))
        kept = kept.where(F.col("nth") <= cap).select(*columns).unionByName(overflow)
    return kept.select(*columns, specificity.alias("specificity")).orderBy(F.desc("n"), "cluster_id")


def shared_by_all(lines: DataFrame, text: str = "text", most: int = 3) -> DataFrame:
    """``(token, n)``: the tokens that every line has, each counted once per line, longest first."""
    total = lines.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("total"))  # one row
    each = lines.select(F.explode(F.array_distinct(tokenize(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return each.join(F.broadcast(total), F.col("n") == F.col("total")).select("token", "n").orderBy(F.desc(F.length("token")), "token").limit(most)


SPLIT = re.compile(r"[\s|,;]+")
