"""Held-out passages that got into a corpus, whole or in part.

Latent semantic retrieval: passages (word windows) of corpus and items are TF-IDF vectors over the
items' vocabulary. Texts are cut into word numbers once. How often two words share a passage is
counted over all passages, and a randomised singular value decomposition of that table, its products
added up over all partitions, gives the latent space; a document is a candidate for an item if one of
its passages is near one of the item's by cosine. Candidates are then decided word by word: a longest
common subsequence with a penalty for skipped words, so a shared sentence pattern or a short phrase
does not count, while single changed, dropped or added words do no harm.

The items are the stated query set and are sent to every task; the corpus is never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import cut, spread

WORD = re.compile(r"[^\W_]+")
DROPPED = str.maketrans("", "", "'’‘`´*_~­​‌‍⁠﻿")
#: Words of a passage, and steps between passages.
WINDOW, STRIDE = 16, 4
#: Size of the latent space, extra random directions, and the least cosine of a candidate.
RANK, EXTRA, NEAR = 160, 32, 0.5
#: A piece counts from so many words after penalties; an item is leaked from so many words in all.
PIECE, LEAST = 13, 16
#: Words that may stand between two runs of one piece.
GAP = 6
#: Most words of all items together: the query set must stay small enough to be sent to every task.
MOST_WORDS = 5_000_000
TEXTS = 512


def words(text: str | None) -> list[str]:
    """Case, punctuation, white space, line and emphasis marks are let aside; a word hyphenated at a
    line end is one word."""
    if not text:
        return []
    return WORD.findall(re.sub(r"(?<=\w)-[ \t]*\r?\n\s*(?=[^\W\d_])", "", text).casefold().translate(DROPPED))


@dataclass
class Items:
    """Held-out items as word numbers. ``size`` counts the words of their texts; that number stands for any other word,
    larger ones for words of answers only."""

    ids: list[int]
    codes: list[np.ndarray]
    answers: list[list[int]]
    vocabulary: dict[str, int]
    size: int

    @classmethod
    def of(cls, rows: list[tuple[int, str | None, str | None]]) -> Items:
        held = [(item, words(text), words(label)) for item, text, label in sorted(rows, key=lambda r: (r[0] is None, r[0]))]
        held = [h for h in held if h[1]]
        if sum(len(w) for _, w, _ in held) > MOST_WORDS:
            raise ValueError(f"the items hold more than {MOST_WORDS} words; search for them in parts")
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws, _ in held for w in ws}))}
        size = len(vocabulary)
        for w in sorted({w for *_, ws in held for w in ws} - vocabulary.keys()):
            vocabulary[w] = len(vocabulary) + 1
        return cls([i for i, *_ in held], [np.array([vocabulary[w] for w in ws], np.int64) for _, ws, _ in held], [[vocabulary[w] for w in ws] for *_, ws in held], vocabulary, size)


def coded(df: DataFrame, key: str, items: Items) -> DataFrame:
    """(key, codes) of every text with words."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((items.vocabulary, items.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, other = shared.value
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                found = [[vocabulary.get(w, other) for w in words(t)] for t in part.column(1).to_pylist()]
                kept = [k for k, c in enumerate(found) if c]
                yield pa.record_batch([part.column(0).take(pa.array(kept, pa.int64())), pa.array([found[k] for k in kept], pa.list_(pa.int32()))], names=[key, "codes"])

    return cut(spread(df.select(key, "text")).mapInArrow(run, f"`{key}` {kind}, codes array<int>"))


def _parts(batches: Iterator[pa.RecordBatch], column: str = "codes") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, all codes in a row, words per text) of bounded parts."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            part = batch.slice(at, TEXTS)
            lists = part.column(part.schema.get_field_index(column))
            yield part, lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of all passages of texts laid out in a row, and the text each belongs to."""
    starts, stops, owner = [], [], []
    base = 0
    for k, n in enumerate(sizes):
        if n:
            a = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
            starts.append(base + a)
            stops.append(np.minimum(base + a + WINDOW, base + n))
            owner.append(np.full(len(a), k))
        base += n
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(starts), np.concatenate(stops), np.concatenate(owner)


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    run = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, 0, out=run[1:])
    return run[stops] - run[starts]


def _project(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Passage vectors times ``basis``; the row for outside words is zero."""
    return _sums(idf[codes, None] * basis[codes], starts, stops)


def document_frequency(corpus: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each word of the items occurs, over the whole corpus, and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(size, np.int64), 0
        for _, codes, sizes in _parts(batches):
            doc = np.repeat(np.arange(len(sizes)), sizes)
            once = np.unique(doc[codes < size] * size + codes[codes < size])
            seen += np.bincount(once % size, minlength=size)
            docs += len(sizes)
        terms = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(terms, -1).astype(np.int32)), pa.array(np.append(seen[terms], docs))], names=["term", "n"])

    rows = {r["term"]: r["n"] for r in corpus.select("codes").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs = rows.pop(-1, 0)
    out = np.zeros(size + 1)
    out[list(rows)] = list(rows.values())
    return out, n_docs


def pair_counts(codes: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(u * size + v, passages) of ordered word pairs, by the number of passages that hold both places."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.repeat((np.maximum(1, sizes - WINDOW + STRIDE) - 1) // STRIDE, sizes)  # number of the text's last passage
    left = np.repeat(sizes, sizes) - place
    keys, counts = [], []
    for gap in range(WINDOW):
        i = np.flatnonzero((codes < size) & (left > gap))
        i = i[codes[i + gap] < size]
        first = np.maximum(-(-(place[i] + gap - WINDOW + 1) // STRIDE), 0)
        n = np.minimum(place[i] // STRIDE, last[i]) - first + 1
        i, n = i[n > 0], n[n > 0]
        u, v = codes[i], codes[i + gap]
        keys += [u * size + v] + ([v * size + u] if gap else [])
        counts += [n] + ([n] if gap else [])
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)


def word_pairs(corpus: DataFrame, size: int) -> DataFrame:
    """(u, v, n): the table A'A of passages and words before weighting; bounded by the items' words, whatever the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, sizes in _parts(batches):
            if (codes < size).any():
                key, n = pair_counts(codes, sizes, size)
                yield pa.record_batch([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(n)], names=["u", "v", "n"])

    return cut(corpus.select("codes").mapInArrow(run, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n")))


def _times(pairs: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The weighted table times ``matrix``, added up per partition, then over partitions."""
    shared = pairs.sparkSession.sparkContext.broadcast((idf, matrix))
    rows, cols = matrix.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = shared.value
        total = np.zeros((rows, cols))
        for batch in batches:
            u, v, n = (batch.column(k).to_numpy() for k in range(3))
            order = np.argsort(u, kind="stable")
            for at in range(0, len(order), 8192):
                o = order[at : at + 8192]
                terms, first = np.unique(u[o], return_index=True)
                total[terms] += np.add.reduceat((n[o] * w[u[o]] * w[v[o]])[:, None] * m[v[o]], first, 0)
        some = np.flatnonzero(np.abs(total).sum(1))
        for at in range(0, len(some), 512):
            block = some[at : at + 512]
            yield pa.record_batch([pa.array(np.repeat(block, cols).astype(np.int32)), pa.array(np.tile(np.arange(cols, dtype=np.int32), len(block))), pa.array(total[block].reshape(-1))], names=["r", "c", "v"])

    table = pairs.mapInArrow(run, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((rows, cols))
    out[table["r"].to_numpy(), table["c"].to_numpy()] = table["v"].to_numpy()
    return out


def latent_space(pairs: DataFrame, idf: np.ndarray, size: int, rank: int = RANK) -> np.ndarray:
    """Basis of the latent space, a row per word (and a zero row for outside words).

    Randomised SVD of the passage matrix A by its table A'A: the range is sampled as A'(A W) for a random W, then
    the small problem (A Q)'(A Q) is solved on the driver. Both products are added up over all partitions."""
    wide = min(size, rank + EXTRA)
    basis, _ = np.linalg.qr(_times(pairs, idf, np.random.default_rng(7).standard_normal((size, wide))))
    small = basis.T @ _times(pairs, idf, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    out = np.zeros((size + 1, min(rank, wide)), np.float32)
    out[:size] = basis @ vectors[:, np.argsort(-values)[: min(rank, wide)]]
    return out


class Aligner:
    """Decides one item: longest common subsequence of words with a penalty per skipped word."""

    def __init__(self, item: list[int]):
        self.longest = len(item)
        self.pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        for j in range(len(item) - 1):
            self.pairs[item[j], item[j + 1]].append(j)

    def pieces(self, doc: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(start and end in the document, start and end in the item, words in common) of the best
        chains of equal runs with a score of ``PIECE`` or more."""
        runs: list[list[int]] = []
        open_: dict[int, list[int]] = {}
        for p in range(len(doc) - 1):
            new = {}
            for j in self.pairs.get((doc[p], doc[p + 1]), ()):
                run = open_.get(j - 1)
                if run is None:
                    run = [p, j, 1]
                    runs.append(run)
                run[2] += 1
                new[j] = run
            open_ = new
        n = len(runs)
        score, common, start, item_start = [r[2] for r in runs], [r[2] for r in runs], [r[0] for r in runs], [r[1] for r in runs]
        extended = [False] * n
        for b in range(n):
            best_a = -1
            for a in range(b - 1, -1, -1):
                if runs[b][0] - runs[a][0] > self.longest + GAP:
                    break  # no run is longer than the item, so none before this one reaches here
                skip, skip_item = runs[b][0] - runs[a][0] - runs[a][2], runs[b][1] - runs[a][1] - runs[a][2]
                if -3 < skip <= GAP and -3 < skip_item <= GAP and runs[b][0] > runs[a][0] and runs[b][1] > runs[a][1]:
                    shared = runs[b][2] + min(0, skip, skip_item)
                    value = score[a] + shared - max(skip, skip_item, 0)
                    if value > score[b] and shared > 0:
                        score[b], common[b], best_a = value, common[a] + shared, a
            if best_a >= 0:
                start[b], item_start[b] = start[best_a], item_start[best_a]
                if score[b] >= score[best_a]:
                    extended[best_a] = True
        return [(start[k], runs[k][0] + runs[k][2], item_start[k], runs[k][1] + runs[k][2], common[k]) for k in range(n) if score[k] >= PIECE and not extended[k]]

    def common(self, doc: list[int]) -> tuple[int, int]:
        """Words in common over pieces in order, and where the last of them ends in the document."""
        pieces = sorted(self.pieces(doc))
        best = [p[4] for p in pieces]
        for b in range(len(pieces)):
            for a in range(b):
                if pieces[a][1] <= pieces[b][0] and pieces[a][3] <= pieces[b][2]:
                    best[b] = max(best[b], best[a] + pieces[b][4])
        if not best:
            return 0, 0
        k = int(np.argmax(best))
        return best[k], pieces[k][1]


def leaks(df: DataFrame, item_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, cosine, n_common, item_words, answer_near) of every leak.

    Null, empty and wordless texts, and items of fewer than ``LEAST`` words, leak nothing. Repeated
    documents are reported each. ``answer_near`` tells whether the words of the item's label stand in a row
    among the twelve after the passage; it decides nothing, as what counts as a leak is defined by the
    words reproduced. Without items, or without documents, the result is empty. Only ``key`` and ``text`` are
    read from the corpus. More than ``MOST_WORDS`` words of items are refused."""
    spark = df.sparkSession
    items = Items.of([(r["item_id"], r["text"], r["label"]) for r in item_rows.select("item_id", "text", "label").collect()])
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id long, cosine double, n_common int, item_words int, answer_near boolean"
    if not items.ids:
        return spark.createDataFrame([], schema)
    size = items.size
    corpus = coded(df, key, items)
    seen, n_docs = document_frequency(corpus, size)
    idf = np.maximum(np.log((n_docs + 2) / (seen + 1)), 0.05).astype(np.float32)  # a word outside the items weighs as the rarest
    own = np.concatenate(items.codes)
    sizes = np.array([len(c) for c in items.codes])
    added, n = pair_counts(own, sizes, size)
    with_items = spark.createDataFrame(pd.DataFrame({"u": added // size, "v": added % size, "n": n}), "u int, v int, n long")
    basis = latent_space(word_pairs(corpus, size).unionByName(with_items), idf, size)
    starts, stops, owner = _windows(sizes)
    norm = np.sqrt(_sums(idf[own] ** 2, starts, stops))
    queries = (_project(own, starts, stops, idf, basis) / norm[:, None]).astype(np.float32)
    shared = spark.sparkContext.broadcast((items, idf, basis, queries, owner))
    names = [key, "item_id", "cosine", "n_common", "item_words", "answer_near"]
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, w, space, query, of_item = shared.value
        aligners: dict[int, Aligner] = {}
        for part, codes, sizes in _parts(batches):
            inner = np.minimum(codes, held.size)
            a, b, doc = _windows(sizes)
            squares = w[inner] ** 2
            whole, inside = _sums(squares, a, b), _sums(np.where(inner < held.size, squares, 0), a, b)
            # A cosine cannot exceed the share of weight that lies inside the items' words.
            near = np.flatnonzero(inside >= NEAR**2 * whole)
            begins = np.cumsum(sizes) - sizes
            best: dict[tuple[int, int], float] = {}
            for at in range(0, len(near), 1024):
                block = near[at : at + 1024]
                # Passages of one length side by side: the words of each are gathered, so only near ones are projected.
                spot = a[block, None] + np.arange(WINDOW)
                real = spot < b[block, None]
                code = np.where(real, inner[np.minimum(spot, len(inner) - 1)], held.size)
                z = np.einsum("pk,pkr->pr", w[code] * (code < held.size), space[code]) / np.sqrt(whole[block])[:, None]
                cos = z.astype(np.float32) @ query.T
                for x, y in zip(*np.nonzero(cos >= NEAR), strict=True):
                    pair = int(doc[block[x]]), int(of_item[y])
                    best[pair] = max(best.get(pair, 0.0), float(cos[x, y]))
            source, rows = [], []
            for (d, k), cosine in sorted(best.items()):
                if k not in aligners:
                    aligners[k] = Aligner(held.codes[k].tolist())
                text = codes[begins[d] : begins[d] + sizes[d]].tolist()
                n, end = aligners[k].common(text)
                if n >= LEAST:
                    answer = held.answers[k]
                    after = text[end : end + 12]
                    told = bool(answer) and any(after[j : j + len(answer)] == answer for j in range(len(after)))
                    source.append(d)
                    rows.append((held.ids[k], min(cosine, 1.0), n, len(held.codes[k]), told))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.record_batch([part.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return corpus.mapInArrow(run, schema)


def found(df: DataFrame, item_rows: DataFrame) -> DataFrame:
    return leaks(df, item_rows).select("doc_id", "item_id").distinct()
