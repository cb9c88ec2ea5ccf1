"""Texts cut off at a field limit or in transfer.

Field limits. Per source and column, histograms of the lengths of texts in characters and in
bytes show the limits: lengths near the maximum at which far more texts end than at the lengths
around them. A text at such a length is cut unless it ends in terminal punctuation.

Transfer. A cut in transfer has any length, so no histogram shows it; texts away from limits
are judged by another method, their ending. One within a character, escape or entity is cut.
Terminal punctuation and dots of omission are complete, and so is a line that closes its last
bracket or quote. Any other ending, the last two words of the last line with names and numbers
masked, is compared with the lines of the corpus that begin alike: it is
complete if, of the lines that reach it, enough stop there rather than go on past it. A line
that another line follows has ended by itself; running text counts only where a paragraph ends.
Some endings only stand last; the last line of a text counts too, therefore, but not for that
text nor for its exact copies, nor if a copy of it is at a limit. A source that often ends
running text without punctuation is not judged by it. There are no lists of marks, phrases or
kinds of line; all shares are of distinct texts, so that the verdict does not move with size.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: A limit holds at least this share of its source's texts and this many,
SPIKE_SHARE, SPIKE_COUNT = 0.01, 5
#: is this many times as frequent as the mean of the lengths within REACH around it,
SPIKE_FACTOR, REACH = 5.0, 40
#: and at most this share of the source's texts is longer.
ABOVE_SHARE = 0.02
#: A byte limit leaves up to this many bytes unused, where a character did not fit.
SLACK = 3
#: An ending is complete if, of the lines that reach it, this share stops there before another line,
STOP_SHARE = 0.01
#: or this share and this many stop there before another line or as last lines of other texts, which might be cut.
LAST_SHARE, LAST_COUNT = 0.03, 2
#: A source ends running text without punctuation by habit if this share of its texts that end in running text does.
HABIT_SHARE = 0.25
#: A line of more words than this that begins with a letter is running text.
FEW_WORDS = 4
#: Endings of this size in bytes, about, are looked for at once.
KEYS_SIZE = 16_000_000

_DAMAGE = r"(?:\N{REPLACEMENT CHARACTER}|\\u[0-9a-fA-F]{0,3}|\\u[dD][89abAB][0-9a-fA-F]{2}|\\x[0-9a-fA-F]?|\\|%[C-F][0-9A-F]|(?<=[^\W\d])%[0-9A-F]?|&#?[a-z0-9]{0,8})$"
_TERMINAL = r"[.!?。！？｡؟।‼⁇⁈⁉][\p{Pe}\p{Pf}\"'`*_]*$"
_OMISSION = r"(?:\.\.\.|…)[\p{Pe}\p{Pf}\"'`*_]*$"


class Endings:
    """Classifies how lines and texts end."""

    def __init__(self) -> None:
        import regex

        self.damage, self.terminal, self.omission = (regex.compile(p).search for p in (_DAMAGE, _TERMINAL, _OMISSION))
        self.digits = regex.compile(r"\d+").sub
        self.letters = regex.compile(r"[^\W\d_]+").sub
        self.compound = regex.compile(r"\w[^\w\s]+\w|\d").search
        self.masked: dict[str, str] = {}

    def kind(self, line: str) -> str:
        """How a line begins: ``prose`` or ``short`` with a letter, else its first character (9 for a digit, a blank for white space)."""
        first = line[0]
        if first.isalpha():
            return "short" if len(line.split(None, FEW_WORDS)) <= FEW_WORDS else "prose"
        return "9" if first.isdigit() else " " if first.isspace() else first

    def mask(self, word: str) -> str:
        """A word in lower case; in names, numbers and addresses letters and digits are masked."""
        found = self.masked.get(word)
        if found is None:
            low = word.lower()
            found = self.digits("9", self.letters("a", low)) if self.compound(low) else low
            if len(word) < 40:
                if len(self.masked) > 200_000:
                    self.masked.clear()
                self.masked[word] = found
        return found

    def words(self, line: str) -> list[str]:
        return [self.mask(w) for w in line.split()]

    def key(self, line: str) -> str:
        return " ".join([self.mask(w) for w in line.rsplit(None, 2)[-2:]])

    def closed(self, line: str) -> bool:
        """Whether a line ends by closing a bracket or double quote, and leaves none open."""
        if line[-1] not in ")]}\"":
            return False
        return all(line.count(a) == line.count(b) for a, b in ("()", "[]", "{}")) and (line.count('"') - line.count('\\"')) % 2 == 0

    def classify(self, text: str | None) -> tuple[str, str, str]:
        """``(ending, kind, key)``: blank, damage, omission, terminal, closed or open."""
        bare = (text or "").rstrip()
        if not bare:
            return "blank", "", ""
        line = bare[max(bare.rfind("\n"), bare.rfind("\r")) + 1 :]
        kind, last = self.kind(line), line.split()[-1]
        for name, shows in (("damage", self.damage), ("omission", self.omission), ("terminal", self.terminal)):
            if shows(last):
                return name, kind, ""
        return ("closed", kind, "") if self.closed(line) else ("open", kind, self.key(line))


def text_id(text: str | None) -> bytes:
    """The same for exact copies of a text, and for them only."""
    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def endings(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, n_text_chars, n_text_bytes, ending, kind, key, text_id)`` of every document."""
    arrow = [("doc_id", pa.int64()), ("source", pa.string()), ("n_text_chars", pa.int64()), ("n_text_bytes", pa.int64()), ("ending", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("text_id", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = Endings()
        for batch in batches:
            ids, sources, texts = (batch.column(i).to_pylist() for i in range(3))
            found = [ends.classify(t) for t in texts]
            columns = (ids, sources, [len(t or "") for t in texts], [len((t or "").encode("utf-8", "replace")) for t in texts], *zip(*found), [text_id(t) for t in texts]) if texts else ([],) * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, arrow)], names=[n for n, _ in arrow])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_text_chars bigint, n_text_bytes bigint, ending string, kind string, key string, text_id binary")


class Passed:
    """Finds where lines go on past given endings."""

    def __init__(self, keys: list[tuple[str, str]]) -> None:
        self.keys = set(keys)
        self.pairs: dict = {}  # by kind and all but the last word: the last words, by their first letter
        for kind, key in keys:
            before, _, last = key.rpartition(" ")
            self.pairs.setdefault(kind, {}).setdefault(before, {}).setdefault(last[0], []).append((last, key))

    def past(self, words: list[str], kind: str) -> Iterator[tuple[str, str]]:
        """The endings that a line goes on past, wherever it does (single words only as the first); short lines and running text go past those of both."""
        for like in ("short", "prose") if kind in ("short", "prose") else (kind,):
            asked = self.pairs.get(like)
            if not asked:
                continue
            before = ""
            for i, word in enumerate(words):
                if (lasts := asked.get(before)) is not None:
                    for last, key in lasts.get(word[0], ()):
                        if word.startswith(last) and (len(word) > len(last) or i < len(words) - 1):
                            yield like, key
                before = word


def _counted(documents: DataFrame, keys: list[tuple[str, str]], name: str, counter) -> DataFrame:
    """``(kind, key, <name>)`` of ``keys``: what ``counter(lines, keys)`` counts in each text, every distinct text taken once."""
    shared = documents.sparkSession.sparkContext.broadcast(keys)
    types = (pa.binary(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(0).to_pylist():
                found = count([x.rstrip() for x in (text or "").rstrip().splitlines()])
                if found:
                    own = text_id(text)
                    for (kind, key), n in found.items():
                        for column, x in zip(out, (own, kind, key, n)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["text_id", "kind", "key", name])

    of_text = documents.select("text").mapInArrow(run, f"text_id binary, kind string, key string, {name} bigint")
    return of_text.groupBy("text_id", "kind", "key").agg(F.max(name).alias(name)).groupBy("kind", "key").agg(F.sum(name).alias(name))


def _stop_counter(keys: list[tuple[str, str]]):
    """How often a line that another follows ends so. Running text may be wrapped anywhere but at the end of a paragraph."""
    ends, asked = Endings(), set(keys)
    kinds = {kind for kind, _ in keys}

    def count(lines: list[str]) -> Counter:
        found: Counter = Counter()
        for line, after in zip(lines, lines[1:]):
            if line and (kind := ends.kind(line)) in kinds and (kind != "prose" or not after) and (kind, (key := ends.key(line))) in asked:
                found[kind, key] += 1
        return found

    return count


def _past_counter(keys: list[tuple[str, str]]):
    """How often a line goes on past an ending."""
    ends, passed = Endings(), Passed(keys)
    kinds = {like for kind, _ in keys for like in (("short", "prose") if kind in ("short", "prose") else (kind,))}

    def count(lines: list[str]) -> Counter:
        found: Counter = Counter()
        for line in lines:
            if line and (kind := ends.kind(line)) in kinds:
                found.update(passed.past(ends.words(line), kind))
        return found

    return count


def stops(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """``(kind, key, n_stop, n_past)`` of the endings ``(kind, key, n_last)`` asked for, in as many passes as they need.

    Where lines go on is counted only for endings at which some line stops, or texts enough: no other can be complete.
    """
    size = asked.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0
    parts = size // KEYS_SIZE + 1
    found = []
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("kind", "key"), F.lit(parts)) == part).collect()
        stopped = _counted(documents, [(r.kind, r.key) for r in rows], "n_stop", _stop_counter)
        stopped = cut(stopped)
        hit = {(r.kind, r.key) for r in stopped.collect()}
        keys = [(r.kind, r.key) for r in rows if (r.kind, r.key) in hit or (r.n_last or 0) - 1 >= LAST_COUNT]
        found.append(stopped.join(_counted(documents, keys, "n_past", _past_counter), ["kind", "key"], "full"))
    return reduce(DataFrame.unionByName, found)


def last_endings(placed: DataFrame) -> DataFrame:
    """``(kind, key, n_last)``: how many distinct texts, of which no copy is at a limit, end so."""
    texts = placed.where(F.col("ending") == "open").groupBy("text_id", "kind", "key").agg(F.max("at_limit").alias("at_limit"))
    return texts.groupBy("kind", "key").agg(F.count_if(~F.col("at_limit")).alias("n_last"))


def habits(placed: DataFrame) -> DataFrame:
    """``(source, open_share)``: of a source's distinct texts away from limits that end in running text, the share that ends without punctuation."""
    ends = placed.where((F.col("kind") == "prose") & ~F.col("at_limit") & F.col("ending").isin("open", "terminal", "omission", "closed"))
    return ends.select("source", "text_id", "ending").distinct().groupBy("source").agg(F.avg((F.col("ending") == "open").cast("double")).alias("open_share"))


# --- field limits -----------------------------------------------------------------------------------


def lengths(documents: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """The histograms ``(source, column, measure, length, n)`` of the columns' lengths in characters and bytes, blank texts left out."""
    source = F.coalesce("source", F.lit(""))
    measured = [
        F.struct(F.lit(c).alias("column"), F.lit(m).alias("measure"), F.when(F.regexp_like(F.col(c), F.lit(r"\S")), of(F.col(c))).cast("bigint").alias("length"))
        for c in columns
        for m, of in (("chars", F.length), ("bytes", F.octet_length))
    ]
    rows = documents.select(source.alias("source"), F.inline(F.array(*measured))).where(F.col("length").isNotNull())
    return rows.groupBy("source", "column", "measure", "length").agg(F.count(F.lit(1)).alias("n"))


def limits(histogram: DataFrame) -> DataFrame:
    """``(source, column, measure, length, n)``: the lengths at which a source's texts are cut.

    A source, column and measure has one row per length that occurs, so the windows sort few rows.
    """
    group = W.partitionBy("source", "column", "measure")
    around = group.orderBy("length").rangeBetween(-REACH, REACH)
    close = group.orderBy("length").rangeBetween(-SLACK, SLACK)
    beyond = group.orderBy(F.col("length").desc()).rangeBetween(W.unboundedPreceding, -SLACK - 1)
    total, near = F.sum("n").over(group), F.sum("n").over(around) - F.sum("n").over(close)
    above = F.coalesce(F.sum("n").over(beyond), F.lit(0))
    scored = histogram.select("*", total.alias("total"), (near / (2 * (REACH - SLACK))).alias("density"), above.alias("above"))
    return scored.where(
        (F.col("n") >= SPIKE_COUNT) & (F.col("n") >= SPIKE_SHARE * F.col("total")) & (F.col("n") >= SPIKE_FACTOR * F.col("density")) & (F.col("above") <= ABOVE_SHARE * F.col("total"))
    ).select("source", "column", "measure", "length", "n")


def with_limits(ended: DataFrame, found: DataFrame) -> DataFrame:
    """``ended`` with ``at_limit``: whether a text has a length at which its source cuts."""
    spikes = found.groupBy("source").agg(
        F.collect_list(F.when(F.col("measure") == "chars", F.col("length"))).alias("char_limits"),
        F.collect_list(F.when(F.col("measure") == "bytes", F.col("length"))).alias("byte_limits"),
    )
    hit: Column = F.exists("char_limits", lambda x: F.col("n_text_chars") == x) | F.exists(
        "byte_limits", lambda x: (F.col("n_text_bytes") > x - SLACK) & (F.col("n_text_bytes") <= x)
    )
    return ended.join(spikes, "source", "left").withColumn("at_limit", F.coalesce(hit, F.lit(False))).drop("char_limits", "byte_limits")


def judged(documents: DataFrame) -> DataFrame:
    """Every document with ``ending``, ``at_limit`` and ``is_cut``.

    Null, empty and blank texts are complete. A null source is a source of its own.
    """
    ended = endings(documents).withColumn("source", F.coalesce("source", F.lit("")))
    placed = cut(with_limits(ended, limits(lengths(documents))))
    lasts = last_endings(placed)
    asked = placed.where((F.col("ending") == "open") & ~F.col("at_limit")).select("kind", "key").distinct().join(lasts, ["kind", "key"])
    known = (
        placed.join(lasts, ["kind", "key"], "left")
        .join(stops(documents, asked), ["kind", "key"], "left")
        .join(habits(placed), "source", "left")
    )
    stop, past, last = (F.coalesce(n, F.lit(0)) for n in ("n_stop", "n_past", "n_last"))
    # a text's own last line is among n_last unless it or a copy is at a limit
    others = stop + F.greatest(last - 1, F.lit(0))
    stops_there = (stop >= 1) & (stop >= STOP_SHARE * (stop + past)) | (others >= LAST_COUNT) & (others >= LAST_SHARE * (others + past))
    habit = (F.col("kind") == "prose") & (F.coalesce("open_share", F.lit(0.0)) >= HABIT_SHARE)
    is_cut = (
        F.when(F.col("ending") == "blank", False)
        .when(F.col("at_limit"), F.col("ending") != "terminal")
        .when(F.col("ending") == "open", ~stops_there & ~habit)
        .otherwise(F.col("ending") == "damage")
    )
    return known.select("doc_id", "source", "n_text_chars", "n_text_bytes", "ending", "at_limit", is_cut.alias("is_cut"))


def found(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the cut texts."""
    return judged(documents).where("is_cut").select("doc_id").distinct()


def at_limits(documents: DataFrame) -> DataFrame:
    """``(source, n_texts, n_at_limit, n_cut_at_limit)``: what the length histograms alone decide, per source."""
    ended = endings(documents).withColumn("source", F.coalesce("source", F.lit(""))).where(F.col("ending") != "blank")
    placed = with_limits(ended, limits(lengths(documents)))
    return placed.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("at_limit").alias("n_at_limit"), F.count_if(F.col("at_limit") & (F.col("ending") != "terminal")).alias("n_cut_at_limit"))


def rates(documents: DataFrame) -> DataFrame:
    """How often each source cuts: ``(source, n_texts, n_cut, n_cut_at_limit, rate)``."""
    return judged(documents).where(F.col("ending") != "blank").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("is_cut").alias("n_cut"), F.count_if(F.col("is_cut") & F.col("at_limit")).alias("n_cut_at_limit"), F.avg(F.col("is_cut").cast("double")).alias("rate")
    )
