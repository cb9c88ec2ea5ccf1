"""Corpus encoding with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern; each partition encodes the words it has
not met yet in DuckDB. A recursive query holds token-position rows, joins neighbouring tokens
with the merge table, contracts the minimum-rank pair of every word (all of its occurrences
from the left that do not overlap, which is what contracting the leftmost again and again
comes to, a merge only ever enabling later ranks) and recurs on the words that changed; an
ordered aggregation reads off the ids. Another decodes them again. No shuffle: rows are encoded
where they are read.

A null or empty text has no ids (an empty list).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of new words that one recursive query takes at once, and words a task remembers before it starts afresh.
CHUNK_BYTES = 150_000
REMEMBERED = 400_000

CONTRACT = """
WITH RECURSIVE step(w, pos, tok, it) AS (
  SELECT w, pos, tok, 0 FROM start_tokens
  UNION ALL
  SELECT w, pos, CASE WHEN take THEN merged ELSE tok END, it + 1
  FROM (
    SELECT *, coalesce(lag(take) OVER (PARTITION BY w ORDER BY pos), false) AS taken
    FROM (
      SELECT *, hit AND (nth - last_miss) % 2 = 1 AS take
      FROM (
        SELECT *, coalesce(max(CASE WHEN NOT hit THEN nth END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS last_miss
        FROM (
          SELECT *, coalesce(rank = least_rank, false) AS hit
          FROM (
            SELECT p.w, p.pos, p.tok, p.it, p.nth, m.rank, m.merged, min(m.rank) OVER (PARTITION BY p.w) AS least_rank
            FROM (
              SELECT w, pos, tok, it, lead(tok) OVER seq AS nxt, row_number() OVER seq AS nth
              FROM step WINDOW seq AS (PARTITION BY w ORDER BY pos)
            ) p LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r
          ) WHERE least_rank IS NOT NULL
        )
      )
    )
  ) WHERE NOT taken
)
SELECT w, list(tok ORDER BY pos) AS ids FROM step
WHERE (w, it) IN (SELECT (w, max(it)) FROM step GROUP BY w) GROUP BY w
"""


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, inverted."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(others)}


def load_vocabulary(path: str) -> tuple[list[int], pa.Table]:
    """Ids of the 256 bytes, and the merge table ``(l, r, rank, merged)`` of a byte-level BPE file."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    ids = model["vocab"]
    of_byte = [0] * 256
    for letter, byte in _byte_letters().items():
        of_byte[byte] = ids[letter]
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    table = pa.table({
        "l": pa.array([ids[a] for a, _ in pairs], pa.int32()), "r": pa.array([ids[b] for _, b in pairs], pa.int32()),
        "rank": pa.array(range(len(pairs)), pa.int32()), "merged": pa.array([ids[a + b] for a, b in pairs], pa.int32()),
    })
    return of_byte, table


class Encoder:
    """Encodes words in DuckDB; one per task."""

    def __init__(self, of_byte: list[int], merges: pa.Table, memory: str = "300MB") -> None:
        import duckdb
        import regex

        self.of_byte = of_byte
        self.split = regex.compile(PATTERN).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        self.con.register("merge_source", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_source")
        self.known: dict[str, list[int]] = {}

    def _contract(self, words: list[str]) -> None:
        w, pos, tok = [], [], []
        for i, word in enumerate(words):
            data = word.encode("utf-8", "surrogatepass")
            w += [i] * len(data)
            pos += range(len(data))
            tok += [self.of_byte[b] for b in data]
        start = pa.table({"w": pa.array(w, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())})
        self.con.register("start_tokens", start)
        got = self.con.sql(CONTRACT).to_arrow_table()
        self.con.unregister("start_tokens")
        for i, ids in zip(got.column("w").to_pylist(), got.column("ids").to_pylist()):
            self.known[words[i]] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every text."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = sorted({word for words in cut for word in words if word not in known}, key=lambda x: (len(x), x))
        part: list[str] = []
        size = 0
        for word in new:
            if part and size + 4 * len(word) > CHUNK_BYTES:
                self._contract(part)
                part, size = [], 0
            part.append(word)
            size += 4 * len(word)
        if part:
            self._contract(part)
        return [[i for word in words for i in known[word]] for words in cut]


def encode_documents(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every document, without special tokens, texts unchanged; other columns are ignored."""
    of_byte, merges = load_vocabulary(vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast((of_byte, merges))  # the vocabulary: a fixed size, about 1 MB
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    narrow = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def load_tokens(path: str) -> pa.Table:
    """``(tok, bytes)`` of a byte-level BPE file, the bytes as hexadecimal digits; special tokens are their text."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
    of = {i: "".join(f"{letters[c]:02x}" for c in token) for token, i in data["model"]["vocab"].items() if token not in special}
    of |= {i: text.encode().hex() for text, i in special.items()}
    return pa.table({"tok": pa.array(list(of), pa.int32()), "bytes": pa.array(list(of.values()), pa.string())})


DECODE = "SELECT d, string_agg(t.bytes, '' ORDER BY pos) AS bytes FROM placed JOIN tokens t USING (tok) GROUP BY d"


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of every list of ids; null and empty lists are empty texts, bytes that are not UTF-8 are replaced.

    An id that the vocabulary has not is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load_tokens(vocabulary))  # the vocabulary: a fixed size
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        con.register("token_source", shared.value)
        con.execute("CREATE TABLE tokens AS SELECT * FROM token_source")
        known = set(shared.value.column("tok").to_pylist())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = [x or [] for x in part.column(1).to_pylist()]
                if unknown := {i for ids in lists for i in ids} - known:
                    raise ValueError(f"ids without a token: {sorted(unknown)[:5]}")
                placed = pa.table({
                    "d": pa.array([d for d, ids in enumerate(lists) for _ in ids], pa.int32()), "pos": pa.array([p for ids in lists for p in range(len(ids))], pa.int32()), "tok": pa.array([i for ids in lists for i in ids], pa.int32()),
                })
                con.register("placed", placed)
                texts = [""] * part.num_rows
                for d, digits in con.execute(DECODE).fetchall():
                    texts[d] = bytes.fromhex(digits).decode("utf-8", "replace")
                con.unregister("placed")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    narrow = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {kind}, text string")
