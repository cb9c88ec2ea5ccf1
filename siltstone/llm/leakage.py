"""Evaluation texts in training text: documents that hold ten consecutive words of a test item.

The normalised n-grams of the test items form a hash set that is broadcast behind a check of
its size; documents are scanned window by window, and a hit is verified on the words
themselves. A larger set of items is met by a shuffle join on the n-grams instead, also
for the spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_WORDS = 10
#: Above this many n-grams the set is not broadcast (about 150 bytes each).
MAX_NGRAMS = 1_000_000
_DROPPED = {0x200B: None, 0x00AD: None}


def words_of(text: str | None) -> list[str]:
    """Normalised words: U+200B and U+00AD deleted, NFKC, lower case, maximal runs of letters and digits."""
    import regex

    if not text:
        return []
    return regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", text.translate(_DROPPED)).lower())


def ngrams(words: list[str], n: int = N_WORDS) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def spans(words: list[str], index: dict[str, tuple], n: int = N_WORDS) -> dict:
    """Item -> list of ``[first word, last word)`` that the document shares with it, overlapping windows joined."""
    firsts = index.get("\x00firsts", ())
    found: dict = {}
    for i in range(len(words) - n + 1):
        if words[i] not in firsts:
            continue
        for item in index.get(" ".join(words[i : i + n]), ()):
            runs = found.setdefault(item, [])
            if runs and runs[-1][1] >= i:
                runs[-1][1] = i + n
            else:
                runs.append([i, i + n])
    return found


def _index(items: DataFrame, n: int) -> dict[str, tuple] | None:
    """The n-grams of all items with the items they are of; None when there are too many."""
    grams = _grams(items.select(F.col("item_id").alias("key"), "text"), n).distinct()
    rows = grams.limit(MAX_NGRAMS + 1).collect()
    if len(rows) > MAX_NGRAMS:
        return None
    index: dict[str, tuple] = {}
    for r in rows:
        index[r.gram] = (*index.get(r.gram, ()), r.key)
    return index | {"\x00firsts": frozenset(g.split(" ", 1)[0] for g in index)}


def _grams(df: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grams = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for g in set(ngrams(words_of(text), n)):
                    keys.append(key)
                    grams.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.string())], names=["key", "gram"])

    return df.mapInArrow(run, "key bigint, gram string")


def _windows(documents: DataFrame, n: int) -> DataFrame:
    """``(doc_id, at, gram)``: every window with the number of its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = ngrams(words_of(text), n)
                if grams:
                    columns = ([key] * len(grams), list(range(len(grams))), grams)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "at", "gram"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, at int, gram string")


def _joined_spans(documents: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``leaked_spans`` by a shuffle join on the n-grams; doc_id is unique."""
    from pyspark.sql import Window as W

    of_items = _grams(items.select(F.col("item_id").alias("key"), "text"), n).select(F.col("key").alias("item_id"), "gram").distinct()
    hits = _windows(documents, n).join(of_items, "gram").select("doc_id", "item_id", "at")
    pair = W.partitionBy("doc_id", "item_id").orderBy("at")
    # a window that starts at or before the end of the one before it continues its run
    starts = F.coalesce(F.col("at") > F.lag("at").over(pair) + n, F.lit(True))
    runs = hits.withColumn("starts", starts).withColumn("run", F.count_if("starts").over(pair))
    return runs.groupBy("doc_id", "item_id", "run").agg(F.min("at").alias("from_word"), (F.max("at") + n).cast("int").alias("to_word")).drop("run")


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """``(doc_id, item_id, from_word, to_word)``: every maximal run of shared windows. Null and short texts have none."""
    index = _index(items, n)
    if index is None:
        return _joined_spans(documents, items, n)
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item, runs in spans(words_of(text), shared.value, n).items():
                    for a, b in runs:
                        for column, x in zip(out, (doc, item, a, b)):
                            column.append(x)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "item_id", "from_word", "to_word"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, from_word int, to_word int")


def leaks(documents: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """``(doc_id, item_id)``, distinct: the document holds ``n`` consecutive words of the item."""
    few = _grams(items.select(F.col("item_id").alias("key"), "text"), n).limit(MAX_NGRAMS + 1).count() <= MAX_NGRAMS
    if few:
        return leaked_spans(documents, items, n).select("doc_id", "item_id").distinct()
    of_items = _grams(items.select(F.col("item_id").alias("key"), "text"), n).select(F.col("key").alias("item_id"), "gram").distinct()
    of_documents = _grams(documents.select(F.col("doc_id").alias("key"), "text"), n).withColumnRenamed("key", "doc_id")
    return of_documents.join(of_items, "gram").select("doc_id", "item_id").distinct()


def scrub(documents: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """``documents`` without those that hold a passage of an item."""
    return documents.join(leaks(documents, items, n).select("doc_id").distinct(), "doc_id", "left_anti")


def word_places(text: str) -> list[tuple[int, int]] | None:
    """Where in ``text`` each of its normalised words stands, or None where that can not be told.

    The text is normalised piece by piece, a letter with its marks at a time; it can not be
    told where the pieces together are not the normalised whole.
    """
    import regex

    out, places = [], []
    for piece in regex.finditer(r"\X", text):
        norm = unicodedata.normalize("NFKC", piece.group().translate(_DROPPED)).lower()
        out.append(norm)
        places += [(piece.start(), piece.end())] * len(norm)
    whole = "".join(out)
    if whole != unicodedata.normalize("NFKC", text.translate(_DROPPED)).lower():
        return None
    return [(places[w.start()][0], places[w.end() - 1][1]) for w in regex.finditer(r"[\p{L}\p{N}]+", whole)]


def without_passages(text: str | None, runs: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``runs`` and what stands between them; empty where their places can not be told."""
    if not text or not runs:
        return text
    places = word_places(text)
    if places is None:
        return ""
    out, at = [], 0
    for a, b in sorted(runs):
        start, end = places[a][0], places[b - 1][1]
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])


def scrub_passages(documents: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """``(doc_id, text, n_removed)``: every document, the passages that it shares with an item cut out; n_removed are the words taken."""
    runs = leaked_spans(documents, items, n).groupBy("doc_id").agg(F.collect_set(F.struct("from_word", "to_word")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, found = (batch.column(i).to_pylist() for i in range(3))
            cut, taken = [], []
            for text, spans_ in zip(texts, found):
                pairs = [(s["from_word"], s["to_word"]) for s in spans_ or []]
                cut.append(without_passages(text, pairs))
                taken.append(len({w for a, b in pairs for w in range(a, b)}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cut, pa.string()), pa.array(taken, pa.int64())], names=["doc_id", "text", "n_removed"])

    # few documents have passages: the others keep their text without a round trip through Python
    joined = documents.select("doc_id", "text").join(runs, "doc_id", "left")
    clean = joined.where(F.col("runs").isNull()).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_removed"))
    return clean.unionByName(joined.where(F.col("runs").isNotNull()).mapInArrow(run, "doc_id bigint, text string, n_removed bigint"))
