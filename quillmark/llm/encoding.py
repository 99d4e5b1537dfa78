"""Byte-pair encoding of a corpus with a public tokenizer's vocabulary.

Each partition runs recursive queries in an embedded DuckDB. Words are laid out as
token-position rows; one step joins neighbouring tokens with the merge table, picks each word's
leftmost pair of lowest rank and contracts it, until no pair is left. Ordered aggregation puts the
words' ids, and the texts' bytes, together again. Nothing is shuffled; words met before in a task
are not encoded twice.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import spread

#: Where the vocabulary files lie; the path is a parameter of every operator here.
TOKENIZERS = os.environ.get("QUILLMARK_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-tokenizer of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept between batches of a task, and texts that go through one query.
REMEMBERED = 200_000
TEXTS = 2_000

#: Token-position rows of every word after each step. A step finds each word's pair of lowest rank
#: and contracts its places from the left; places that overlap (a run of one letter) alternate, so
#: the outcome is that of contracting the leftmost place again and again.
STEP = """
WITH RECURSIVE step AS (
    SELECT 0 AS n, word, pos, id FROM symbols
  UNION ALL
    (WITH pair AS (
        SELECT s.*, m.merged, row_number() OVER w AS idx,
               min(m.merged) OVER (PARTITION BY s.word) AS best
        FROM (SELECT n, word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next_id FROM step) s
        LEFT JOIN merges m ON m.a = s.id AND m.b = s.next_id
        WINDOW w AS (PARTITION BY s.word ORDER BY s.pos)),
      place AS (
        SELECT *, merged = best AS here, idx - row_number() OVER (PARTITION BY word, merged = best ORDER BY idx) AS island
        FROM pair WHERE best IS NOT NULL),
      chosen AS (
        SELECT *, coalesce(here, false) AND row_number() OVER (PARTITION BY word, here, island ORDER BY idx) % 2 = 1 AS take
        FROM place),
      kept AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY idx), false) AS gone FROM chosen)
     SELECT n + 1, word, pos, CASE WHEN take THEN merged ELSE id END FROM kept WHERE NOT gone)
)
"""
ENCODE = STEP + """
SELECT word, list(id ORDER BY pos) AS ids
FROM (SELECT *, max(n) OVER (PARTITION BY word) AS last FROM step) WHERE n = last GROUP BY word
"""
DECODE = """
SELECT doc, string_agg(t.hex, '' ORDER BY pos) AS hex FROM given JOIN vocabulary t USING (id) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """(left id, right id, merged id) for every way to put a token together of two others; the
    merged id is the rank."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    return left, right, merged


class Encoder:
    """One partition's database with the merge table."""

    def __init__(self, vocabulary: str):
        import duckdb
        import regex

        self.ranks = read_ranks(vocabulary)
        self.words = regex.compile(PATTERN)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": "false"})
        left, right, merged = merge_rows(self.ranks)
        rows = pa.table({"a": pa.array(left, pa.int32()), "b": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT a, b, merged FROM rows")
        tokens = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks], pa.string())})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, hex FROM tokens")
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: list[str]) -> None:
        """Ids of new words, a bounded number of token rows at a time."""
        for block in _blocks(words, 40_000):
            self._encode(block)

    def _encode(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        ids = pa.array([self.bytes[b] for b in chain.from_iterable(raw)], pa.int32())
        word = pa.array(list(chain.from_iterable([k] * len(r) for k, r in enumerate(raw))), pa.int32())
        pos = pa.array(list(chain.from_iterable(range(len(r)) for r in raw)), pa.int32())
        symbols = pa.table({"word": word, "pos": pos, "id": ids})
        self.db.register("given", symbols)
        self.db.execute("CREATE OR REPLACE TEMP TABLE symbols AS SELECT * FROM given")
        self.db.unregister("given")
        got = self.db.sql(ENCODE).to_arrow_table()
        for k, out in zip(got["word"].to_pylist(), got["ids"].to_pylist(), strict=True):
            self.known[words[k]] = tuple(out)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.words.findall(t) if t else [] for t in texts]
        fresh = {w for ws in split for w in ws if w not in self.known}
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = {w for ws in split for w in ws}
        self.learn(sorted(fresh))
        known = self.known
        return [list(chain.from_iterable([known[w] for w in ws])) for ws in split]

    def decode(self, rows: list[list[int] | None]) -> list[str]:
        doc = pa.array(list(chain.from_iterable([k] * len(r or ()) for k, r in enumerate(rows))), pa.int32())
        pos = pa.array(list(chain.from_iterable(range(len(r or ())) for r in rows)), pa.int32())
        ids = pa.array(list(chain.from_iterable(r or () for r in rows)), pa.int32())
        self.db.register("given", pa.table({"doc": doc, "pos": pos, "id": ids}))
        out = [""] * len(rows)
        for k, text in self.db.execute(DECODE).fetchall():
            out[k] = bytes.fromhex(text).decode("utf-8", "replace")
        self.db.unregister("given")
        return out


def _blocks(words: list[str], most: int) -> Iterator[list[str]]:
    block: list[str] = []
    size = 0
    for w in words:
        block.append(w)
        size += len(w)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One per worker process, kept for its later tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>), one row per row of ``df``, without special tokens; strings that look
    like special tokens are ordinary text. Null and empty texts give an empty array, never null.
    Blank texts are encoded as they are. Repeated rows are repeated. Only ``key`` and ``text`` are read."""
    vocabulary = os.path.join(folder, f"{name}.tiktoken")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                ids = own.encode(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the inverse; a null or empty array gives an empty text."""
    vocabulary = os.path.join(folder, f"{name}.tiktoken")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                yield pa.record_batch([part.column(0), pa.array(own.decode(part.column(1).to_pylist()), pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(df: DataFrame) -> DataFrame:
    """Per document: characters, tokens and whether decoding gives the text back."""
    back = decode(encode(df)).withColumnsRenamed({"text": "back"})
    own = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.join(back, "doc_id").select("doc_id", F.length("text").alias("n_signs"), (F.col("text") == F.col("back")).alias("same"))
