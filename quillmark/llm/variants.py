"""Variant spellings of typed names, linked per entity.

Every distinct value becomes one weighted vector, whatever the order its parts were typed in: letter
n-grams of the part that carries the identity (surname, a firm's own word), what its given name or
line of business may stand for, and what the value was seen with (profile, firm). A rare word of a
name takes on the feature of the far commoner word nearest to it by n-gram cosine (a top-1 join of
words), so slips and abbreviations meet the word that was meant; lists of short forms and of usual
given names only add features. A sparse join gives all pairs of vectors whose cosine reaches a
bound: they meet at the first features they share, as many together as keep the meeting small, so
common features alone never meet and nothing is cut off. The cosines alone are the scores of
average-linkage clustering: in rounds over the whole graph, clusters that are each other's nearest
merge at once, which gives the same result as one merge after another.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import names
from quillmark.session import cut, cut_anew, ship, spread

#: Least cosine of two vectors that are compared at all.
COSINE = 0.5
#: Least average cosine within an entity.
LINKAGE = {"person": 0.6, "company": 0.6}
#: Squared length that each block of features has in a vector with all blocks.
ENERGY = {"surname": 0.45, "given": 0.32, "middle": 0.05, "generation": 0.05, "core": 0.55, "line": 0.15, "legal": 0.05}
SEEN_WITH = {"person": 0.23, "company": 0.25}
#: A word counts as a slip or short form of one so many times as common, from this cosine.
COMMONER, SHORTENS, WORD_COSINE = 8, 2, {"person": 0.44, "company": 0.3}
#: A word that opens the names of so many surnames is a given name.
GIVEN_SUPPORT = 4
#: Most merges of a round that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: A feature is heavy if so many of its usual squared weight reach the bound of a cosine join.
HEAVY = 3
#: Vectors that hold the same first features are compared up to so many, and else told apart by one feature more, up to
#: that many features; meetings of still more are compared in blocks of that size.
TOGETHER, DEPTH, BLOCK = 200, 6, 1000
#: Bits of a bucket's number in a vector's code; below FEW, vectors that meet are compared pair by pair, so many at once.
BITS, FEW, CHUNK = 9, 12, 4096


def cosine_join(vectors: DataFrame, least: float, top: int | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs with cosine >= ``least``, a < b, of unit vectors (id, feature, w), w > 0.

    Exact: every pair is found, whatever the lengths or counts. Heavy features stand before light ones and
    rare before common. A pair meets at its first common features: at the first alone where few vectors hold
    it, else at the first two together, and so on, so no common feature brings many vectors together. Left
    out are only pairs whose remaining lengths bound the cosine below ``least``. ``top`` keeps, for each id,
    its that many nearest (both directions as rows (a, b) then; equal cosines: the smaller b)."""
    ship(vectors.sparkSession)
    bound, kind = least * least - 1e-9, vectors.schema["id"].dataType.simpleString()
    seen = cut(vectors.groupBy("feature").agg(F.count("*").alias("df"), (F.avg(F.col("w") * F.col("w")) < bound / HEAVY).alias("light")).where("df > 1").withColumn("f", F.monotonically_increasing_id()))
    lists = vectors.join(seen, "feature").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("light", "df", "f", "w"))).alias("v"))
    whole = cut(lists.select("id", F.monotonically_increasing_id().alias("n"), F.col("v.f").alias("f"), F.col("v.w").alias("w")).mapInArrow(_rests, f"id {kind}, n bigint, f array<bigint>, w array<double>, rest array<double>, code binary"))
    near = _meetings(whole, bound).mapInArrow(_near(least), "a bigint, b bigint").distinct()
    side = lambda s: whole.select(F.col("n").alias(s), F.col("id").alias(f"id_{s}"), F.col("f").alias(f"f_{s}"), F.col("w").alias(f"w_{s}"))
    both = near.join(side("a"), "a").join(side("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "f_a", "w_a", "f_b", "w_b")
    near = both.mapInArrow(_dots, f"a {kind}, b {kind}, cosine double").where(F.col("cosine") >= least - 1e-12)
    if top is None:
        return near
    ways = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    return ways.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("k") <= top).drop("k")


def _meetings(whole: DataFrame, bound: float) -> DataFrame:
    """(k, side, n, r, code), sorted by k within partitions: vectors under each k are to be compared, but not two of the
    same side 1 or 2. ``r`` is the squared length of what two vectors first meeting there can still share."""
    places = whole.select("n", F.posexplode(F.arrays_zip("f", "w", "rest")).alias("j", "c")).select("n", "j", "c.f", (F.col("c.w") * F.col("c.w")).alias("e"), "c.rest")
    rows = places.where(F.col("rest") >= bound).select(F.col("f").alias("k"), "n", "j", F.col("e").alias("p"), F.col("rest").alias("r"))
    at = Window.partitionBy("k")
    met: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        # Two vectors share at most the root of their r multiplied.
        kept = rows.withColumn("most", F.max("r").over(at)).where(F.col("r") * F.col("most") >= bound).drop("most")
        kept = cut(kept.withColumn("size", F.count("*").over(at)).withColumn("alone", F.col("p") * F.max("p").over(at) >= bound).where("size > 1"))
        large = kept.where(F.col("size") > TOGETHER)
        met.append(kept.where(F.col("size") <= TOGETHER).select("k", F.lit(0).alias("side"), "n", "r"))
        last = depth == DEPTH
        # Of a large meeting, those whose first common features may be all they share still meet there.
        met.append(_blocks(large if last else large.where("alone").withColumn("r", F.col("p"))))
        if last or large.isEmpty():
            break
        further = large.select("k", "n", "p", F.col("j").alias("i")).join(places, "n").where((F.col("j") > F.col("i")) & (F.col("p") + F.col("rest") >= bound))
        rows = further.select(F.xxhash64("k", "f").alias("k"), "n", "j", (F.col("p") + F.col("e")).alias("p"), (F.col("p") + F.col("rest")).alias("r"))
    every = met[0]
    for m in met[1:]:
        every = every.unionByName(m)
    return every.join(whole.select("n", "code"), "n").select("k", "side", "n", "r", "code").repartition("k").sortWithinPartitions("k")


def _blocks(large: DataFrame) -> DataFrame:
    """Meetings of many, dealt to tasks as pairs of blocks."""
    of = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = large.withColumn("own", F.pmod(F.xxhash64("n"), of).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), side.alias("side"), "n", "r")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the number of the list that each is from."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the squared length from each feature on, and a code of the vector: bucket and weight, rounded up, of each feature."""
    for batch in batches:
        f, w = batch.column(2), batch.column(3)
        flat, row = _flat(w)
        after = np.cumsum((flat * flat)[::-1])[::-1]
        ends = np.searchsorted(row, np.arange(1, batch.num_rows + 1))
        rest = after - np.append(after, 0.0)[ends][row]
        bucket = ((_flat(f)[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype("<u2")
        weight = np.minimum(np.ceil(flat * 255), 255).astype(np.uint8)
        starts = np.append(0, ends[:-1])
        codes = [bucket[x:y].tobytes() + weight[x:y].tobytes() for x, y in zip(starts, ends, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(rest))
        yield pa.record_batch([batch.column(0), batch.column(1), f, w, lists, pa.array(codes, pa.binary())], names=["id", "n", "f", "w", "rest", "code"])


def _lengths(codes: list[bytes]) -> np.ndarray:
    """A row per code: the length of the vector within each bucket, never too small."""
    sizes = np.array([len(c) // 3 for c in codes])
    bucket = np.frombuffer(b"".join(c[: 2 * n] for c, n in zip(codes, sizes, strict=True)), "<u2").astype(np.int64)
    weight = np.frombuffer(b"".join(c[2 * n :] for c, n in zip(codes, sizes, strict=True)), np.uint8) / 255.0
    squares = np.bincount((np.repeat(np.arange(len(codes)), sizes) << BITS) + bucket, weight * weight, len(codes) << BITS)
    return np.sqrt(squares, dtype=np.float32, casting="same_kind").reshape(len(codes), 1 << BITS)


def _near(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b), a < b, of vectors that meet and whose lengths within buckets don't rule the cosine out."""

    def pairs(k: np.ndarray, side: np.ndarray, n: np.ndarray, r: np.ndarray, codes: list[bytes]) -> Iterator[pa.RecordBatch]:
        lengths, rows = _lengths(codes), np.arange(len(k))
        ends = np.searchsorted(k, k, "right")

        def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            may = (r[a] * r[b] >= least * least - 1e-9) & (n[a] != n[b]) & ((side[a] == 0) & (side[b] == 0) | (side[a] != side[b]))
            return a[may], b[may]

        def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.minimum(n[a], n[b])), pa.array(np.maximum(n[a], n[b]))], names=["a", "b"])

        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else rows
        few = (ends - np.searchsorted(k, k)) < FEW
        for x in starts[~few[starts]].tolist():
            block = lengths[x : ends[x]]
            a, b = np.nonzero(block @ block.T >= least - 1e-4)
            yield told(*close(x + a[a < b], x + b[a < b]))
        rows = rows[few]
        others = ends[few] - rows - 1
        upto, start = np.cumsum(others), 0
        while start < len(rows):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + CHUNK, "right")))
            count = others[start:end]
            a = np.repeat(rows[start:end], count)
            a, b = close(a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count))
            near = np.einsum("ij,ij->i", lengths[a], lengths[b]) >= least - 1e-4
            yield told(a[near], b[near])
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
            k, side, n, r = (table.column(c).to_numpy() for c in range(4))
            return pairs(k, side, n, r, table.column(4).to_pylist())

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # The last k may go on in the next batch.
            first = int(np.searchsorted(batch.column(0).to_numpy(), batch.column(0)[-1].as_py()))
            if first or held[0].column(0)[0].as_py() != batch.column(0)[-1].as_py():
                yield from meet(pa.Table.from_batches([*held[:-1], batch.slice(0, first)]))
                held = [batch.slice(first)]
        if held:
            yield from meet(pa.Table.from_batches(held))

    return run


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (fa, row_a), (fb, row_b) = _flat(batch.column(2)), _flat(batch.column(4))
        f, row, w = np.concatenate([fa, fb]), np.concatenate([row_a, row_b]), np.concatenate([_flat(batch.column(3))[0], _flat(batch.column(5))[0]])
        order = np.lexsort((f, row))
        f, row, w = f[order], row[order], w[order]
        same = np.flatnonzero((f[1:] == f[:-1]) & (row[1:] == row[:-1]))
        dots = np.bincount(row[same], w[same] * w[same + 1], batch.num_rows)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dots)], names=["a", "b", "cosine"])


def unit_vectors(cells: DataFrame, n: int) -> DataFrame:
    """(id, feature, w) of cells (id, block, feature, w, energy), one row per id and feature.

    Within a block: given weight times the root of the inverse document frequency among ``n`` vectors (the
    features of a slip are rare, and must not drown the others). A block has its energy as squared
    length, and the blocks a vector has share the length of 1."""
    seen = cells.groupBy("feature").agg(F.count("*").alias("df"))
    idf = F.sqrt(F.ln(F.lit(n + 1.0) / F.col("df")) + 0.1)
    weighed = cells.join(seen, "feature").withColumn("w", F.col("w") * F.when(F.col("block").isin("given", "line", "middle", "legal", "generation"), 1.0).otherwise(idf))
    by_block = Window.partitionBy("id", "block")
    weighed = weighed.withColumn("w", F.col("w") * F.sqrt(F.col("energy") / F.sum(F.col("w") * F.col("w")).over(by_block)))
    return weighed.select("id", "feature", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("w"))


def grams(text: str, sizes: tuple[int, ...] = (2, 3)) -> dict[str, float]:
    padded = f"^{text}$"
    out: dict[str, float] = defaultdict(float)
    for size in sizes:
        for k in range(len(padded) - size + 1):
            out[padded[k : k + size]] += 1.0
    return dict(out)


def skips(text: str) -> dict[str, float]:
    """Ordered pairs of the first letter and the consonants, the nearer the heavier: what an abbreviation keeps."""
    kept = text[0] + "".join(c for c in text[1:] if c not in "aeiou")
    out: dict[str, float] = defaultdict(float)
    out[f"^{text[0]}"] = 1.0
    for i in range(len(kept)):
        for j in range(i + 1, len(kept)):
            out[kept[i] + kept[j]] += 0.8 ** (j - i - 1)
    return dict(out)


def sparse_cosine_join(cores: DataFrame, least: float = COSINE) -> DataFrame:
    """(a, b, cosine) of all pairs of distinct strings in ``core`` by letter n-grams, weighted by frequency and the
    root of the inverse document frequency. Null and empty strings have no neighbours."""
    distinct = cut(cores.where("core IS NOT NULL AND core <> ''").select("core").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, "core", g, w, 1.0) for s in batch.column(0).to_pylist() for g, w in grams(s).items()]
            yield _cells(rows)

    return cosine_join(unit_vectors(distinct.mapInArrow(run, CELLS), distinct.count()), least)


CELLS = "id string, block string, feature string, w double, energy double"


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "block", "feature", "w", "energy"])


def average_linkage(edges: DataFrame, least: float | Column = LINKAGE["person"]) -> DataFrame:
    """(node, cluster) of every node that joins another.

    ``edges``: (a, b, score) with a < b, scores above 0, up to 1; a pair without an edge scores 0.
    Merges while the average score between two clusters is at least ``least`` (a number, or a column of
    ``a``). Equal averages: the smaller id wins. A cluster bears its smallest node's id. A round is a few
    joins of the whole edge table; no component is ever gathered. Every round merges at least the nearest
    pair of each live component, so the rounds end; they are about as many as a dendrogram is high."""
    spark = edges.sparkSession
    bound = F.lit(least) if isinstance(least, float) else least
    now = cut_anew(edges.where("score > 0").select("a", "b", F.lit(1.0).alias("na"), F.lit(1.0).alias("nb"), F.col("score").alias("s")))
    steps: list[DataFrame] = []
    while True:
        live = now.withColumn("avg", F.col("s") / (F.col("na") * F.col("nb"))).where(F.col("avg") >= bound)
        # One global order of pairs breaks ties, so the nearest of all is always mutual.
        ways = live.select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("n"), F.struct((-F.col("avg")).alias("d"), F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("na") + F.col("nb")).alias("size")).alias("m"))
        best = ways.groupBy(F.col("n.x").alias("x")).agg(F.min("m").alias("m")).select("m.*")
        merges = best.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n = 2")
        renamed = cut_anew(merges.select(F.explode(F.array("lo", "hi")).alias("old"), F.col("lo").alias("new"), "size"))
        count = renamed.count()
        if not count:
            break
        steps.append(renamed.select("old", "new"))
        small = count <= BROADCAST_ROWS
        ra, rb = (renamed.select(F.col("old").alias(s), F.col("new").alias(f"new_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab")
        mapped = now.join(F.broadcast(ra) if small else ra, "a", "left").join(F.broadcast(rb) if small else rb, "b", "left")
        x, y, nx, ny = F.coalesce("new_a", "a"), F.coalesce("new_b", "b"), F.coalesce("size_a", "na"), F.coalesce("size_b", "nb")
        first = F.when(x < y, F.struct(x.alias("a"), y.alias("b"), nx.alias("na"), ny.alias("nb"))).otherwise(F.struct(y.alias("a"), x.alias("b"), ny.alias("na"), nx.alias("nb")))
        now = cut_anew(mapped.where(x != y).select(first.alias("p"), "s").groupBy("p").agg(F.sum("s").alias("s")).select("p.*", "s"))
    if not steps:
        return spark.createDataFrame([], "node string, cluster string")
    # A node's first merge names its cluster, which later merges rename.
    own = None
    for step in steps:
        if own is None:
            own = step.select(F.col("old").alias("node"), F.col("new").alias("cluster"))
            continue
        joined = own.join(step, own["cluster"] == step["old"], "full_outer")
        own = joined.select(F.coalesce("node", "old").alias("node"), F.coalesce("new", "cluster").alias("cluster"))
    return cut(own)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, word, other, opens): the words whose meaning other names can tell."""
    for batch in batches:
        rows: list[tuple] = []
        for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if kind == "person":
                p = names.person(value)
                if p and p.given and p.surname and len(p.given[0]) > 1:
                    rows += [(kind, value, p.given[0], p.surname, True), (kind, value, p.surname, p.given[0], False)]
            elif f := names.firm(value):
                rows += [(kind, value, w, f.core, True) for w in f.line]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.record_batch([pa.array(c, pa.bool_() if k == 4 else pa.string()) for k, c in enumerate(columns)], names=["kind", "value", "word", "other", "opens"])


def _word_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for kind, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [(f"{kind}|{word}", "given", f"{kind}|{g}", w, 1.0) for g, w in (grams(word) if kind == "person" else skips(word)).items()]
        yield _cells(rows)


def word_meanings(words: DataFrame) -> DataFrame:
    """(kind, word, known, meant): whether a word is a given name, and the far commoner word it is a slip or short
    form of, if any. ``words``: rows of ``_words``. Listed given names are slips of no other."""
    once = words.select("kind", "word", "other", "opens").distinct()
    stats = cut(once.groupBy("kind", "word").agg(F.count_if("opens").alias("n"), F.count_if(~F.col("opens")).alias("ends")).where("n > 0"))
    near = cosine_join(unit_vectors(stats.select("kind", "word").mapInArrow(_word_cells, CELLS), 1), min(WORD_COSINE.values()))
    ways = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    side = lambda s: stats.select(F.concat_ws("|", "kind", "word").alias(s), F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}"))
    ways = ways.join(side("a").withColumn("kind", F.substring_index("a", "|", 1)), "a").join(side("b"), "b")
    longer = F.length("word_b") > F.length("word_a") + 1
    person = (F.col("kind") == "person") & (F.col("cosine") >= WORD_COSINE["person"]) & (F.col("n_b") >= COMMONER * F.col("n_a")) & ~F.col("word_a").isin(*sorted(names.USUAL | names.FORMAL.keys()))
    firm = (F.col("kind") == "company") & ((F.col("n_b") >= COMMONER * F.col("n_a")) | (longer & (F.col("n_b") >= SHORTENS * F.col("n_a"))))
    meant = ways.where(person | firm).groupBy("kind", F.col("word_a").alias("word")).agg(F.max_by("word_b", F.struct("cosine", "n_b", "word_b")).alias("meant"))
    known = (F.col("kind") == "person") & (F.col("n") >= GIVEN_SUPPORT) & (F.col("n") >= F.col("ends")) & F.col("meant").isNull() & ~F.contains("word", F.lit(names.LOST))
    return stats.join(meant, ["kind", "word"], "left").select("kind", "word", known.alias("known"), "meant").where("known OR meant IS NOT NULL")


def told(values: DataFrame) -> DataFrame:
    """(kind, value, known, meant) of the values that hold a known given name or a word with another meaning."""
    words = cut(values.mapInArrow(_words, "kind string, value string, word string, other string, opens boolean"))
    by_value = words.select("kind", "value", "word").join(word_meanings(words), ["kind", "word"])
    return by_value.groupBy("kind", "value").agg(F.collect_set(F.when(F.col("known"), F.col("word"))).alias("known"), F.collect_set(F.when(F.col("meant").isNotNull(), F.struct("word", "meant"))).alias("meant"))


def person_features(p: names.Person, meant: dict[str, str]) -> list[tuple[str, str, float]]:
    """(block, feature, weight): n-grams of the surname; initials and full forms the given name may stand for."""
    first = p.given[0]
    out = [("surname", f"s|{g}", w) for g, w in grams(p.surname).items()]
    true = meant.get(first, first)
    full = {true} if len(true) == 1 else names.FORMAL.get(true, frozenset({true}))
    initials = {f[0] for f in full} | ({true[0]} if first in meant else {first[0]})
    out += [("given", f"i|{i}", math.sqrt((1.0 if len(first) == 1 else 0.5) / len(initials))) for i in sorted(initials)]
    if len(first) > 1:
        out += [("given", f"g|{f}", math.sqrt(0.5 / len(full))) for f in sorted(full)]
    if len(p.given) > 1:
        out.append(("middle", f"m|{p.given[1][0]}", 1.0))
    if p.generation:
        out.append(("generation", f"j|{p.generation}", 1.0))
    return out


def firm_features(f: names.Firm, meant: dict[str, str]) -> list[tuple[str, str, float]]:
    out = [("core", f"s|{g}", w) for g, w in grams(f.core, (1, 2)).items()]
    out += [("line", f"l|{w}", 1.0) for w in sorted({meant.get(w, w) for w in f.line})]
    return [*out, ("legal", f"f|{f.legal}", 1.0)] if f.legal else out


FEATURES = "array<struct<block:string,feature:string,w:double,energy:double>>"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, node, cells): node is the normal form with its meanings, alike for values that differ in case, marks,
    order, titles or garbling only."""
    cell = pa.list_(pa.struct([("block", pa.string()), ("feature", pa.string()), ("w", pa.float64()), ("energy", pa.float64())]))
    for batch in batches:
        rows = []
        for kind, value, known, pairs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            meant = {p["word"]: p["meant"] for p in pairs or ()}
            if kind == "person":
                p = names.person(value, frozenset(known or ()))
                if p is None or not p.surname or not p.given:
                    continue
                first = p.given[0]
                sure = len(first) > 1 and (first in names.USUAL or first in names.FORMAL or first in (known or ()))
                key, cells = f"{p.key}|{' '.join(sorted(names.FORMAL.get(first, {first})))}" if sure else f"{p.key}|", person_features(p, meant)
            else:
                f = names.firm(value)
                if f is None:
                    continue
                key, cells = f"{f.key}|{' '.join(sorted({meant.get(w, w) for w in f.line}))}", firm_features(f, meant)
            rows.append((kind, value, f"{kind}|{key}", [{"block": b, "feature": f"{kind}|{x}", "w": w, "energy": ENERGY[b]} for b, x, w in cells]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), cell), strict=True)], names=["kind", "value", "node", "cells"])


def agreeing(a: Column, b: Column) -> Column:
    """The exact check after the cosine. Nodes: person|given names|surname|generation|full forms where the given name is
    certain, and company|core|line|legal form|meant line. Not two certain given names without a full form in common
    (relatives), different further initials or generations, nor different lines of business or legal forms (sister firms)."""
    x, y = F.split(a, r"\|"), F.split(b, r"\|")
    part = lambda p, k: F.try_element_at(p, F.lit(k))
    further = lambda p: F.coalesce(F.substring(F.try_element_at(F.split(part(p, 2), " "), F.lit(2)), 1, 1), F.lit(""))
    apart = lambda u, v: (u != "") & (v != "") & (u != v)
    unlike = apart(part(x, 5), part(y, 5)) & ~F.arrays_overlap(F.split(part(x, 5), " "), F.split(part(y, 5), " "))
    return ~(unlike | apart(part(x, 4), part(y, 4)) | (a.startswith("person|") & apart(further(x), further(y))))


def entities(seen: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(kind, value, entity) of every distinct value that has another spelling.

    ``seen``: (kind, value, context) rows; ``kind`` is person or company, ``context`` what a value was seen with, such
    as a profile; it may be null. Null, empty and blank values, and persons without a surname or a given name,
    belong to no entity. Repeated rows count once. Values of equal normal form are one node of the clustering."""
    seen = cut(spread(seen.where("trim(value) <> ''").select("kind", "value", "context").distinct()))
    values = seen.select("kind", "value").distinct()
    read = cut(values.join(told(values), ["kind", "value"], "left").mapInArrow(_vectors, f"kind string, value string, node string, cells {FEATURES}"))
    nodes = read.groupBy("node").agg(F.first("cells").alias("cells"))
    cells = nodes.select(F.col("node").alias("id"), F.explode("cells").alias("c")).select("id", "c.block", "c.feature", "c.w", "c.energy")
    at = seen.where("context IS NOT NULL").join(read.select("kind", "value", "node"), ["kind", "value"])
    at = at.select(F.col("node").alias("id"), F.lit("context").alias("block"), F.concat_ws("|", "kind", F.lit("x"), "context").alias("feature"), F.lit(1.0).alias("w"), F.when(F.col("kind") == "person", SEEN_WITH["person"]).otherwise(SEEN_WITH["company"]).alias("energy")).distinct()
    near = cosine_join(unit_vectors(cut(cells.unionByName(at)), nodes.count()), cosine).where(agreeing(F.col("a"), F.col("b")))
    bound = F.when(F.col("a").startswith("person|"), LINKAGE["person"]).otherwise(LINKAGE["company"])
    clusters = average_linkage(near.withColumnRenamed("cosine", "score"), bound)
    own = read.select("kind", "value", "node").join(clusters, "node", "left").select("kind", "value", F.coalesce("cluster", "node").alias("entity"))
    return own.withColumn("n", F.count("*").over(Window.partitionBy("entity"))).where("n > 1").drop("n")


def mentions(df: DataFrame, kinds: tuple[str, ...] = ("person", "company")) -> DataFrame:
    """(kind, value, context) of the typed names, with the profile and firm, or profile and person, they were seen with; one scan."""
    page = F.concat(F.lit("u|"), F.nullif(F.lower(F.regexp_replace(F.regexp_replace("profile_url", "(?s)[?#].*$", ""), "/+$", "")), F.lit("")))
    firm = F.concat(F.lit("c|"), F.nullif(F.lower(F.regexp_extract("company_name", r"([\p{L}\p{N}]{3,})", 1)), F.lit("")))
    who = F.concat(F.lit("p|"), F.array_join(F.array_sort(F.regexp_extract_all(F.lower("person_name"), F.lit(r"([\p{L}\p{M}]+)"), 1)), " "))
    rows = {
        "person": [F.struct(F.lit("person").alias("kind"), F.col(v).alias("value"), c.alias("context")) for v in ("person_name", "author_name") for c in (page, firm)],
        "company": [F.struct(F.lit("company").alias("kind"), F.col("company_name").alias("value"), c.alias("context")) for c in (page, who)],
    }
    return df.select(F.explode(F.array(*[s for k in kinds for s in rows[k]])).alias("m")).select("m.*")


def found(df: DataFrame) -> DataFrame:
    """(kind, name_a, name_b): pairs of different stored values of one entity, name_a < name_b. The pairs are what the
    query asks for; ``entities`` gives the same as one row per value."""
    own = cut(entities(mentions(df)))
    a, b = (own.select("kind", "entity", F.col("value").alias(f"name_{s}")) for s in "ab")
    return a.join(b, ["kind", "entity"]).where("name_a < name_b").select("kind", "name_a", "name_b").distinct()
